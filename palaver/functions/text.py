"""Text primitives as column expressions.

Null, missing and empty are one: every function takes null as "". All of them run in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palaver.functions.entities import decoded

# Markers, placeholders and patterns that results must carry or match.
UNUSABLE_SPEAKERS = ["", "[deleted]", "deleted", "none", "null"]
UNUSABLE_TEXTS = ["", "[deleted]", "[removed]", "deleted", "removed", "none", "null"]
AUTOMOD = "automoderator"
REDACTIONS = [
    (r"(?i)https?://(?:(?:www|old|np)\.)?reddit\.com/r/[A-Za-z0-9_]+/comments/[A-Za-z0-9]+[^\s<>()\]]*", "[REDDIT THREAD]"),
    (r"(?i)https?://(?:www\.)?redd\.it/[A-Za-z0-9]+[^\s<>()\]]*", "[REDDIT THREAD]"),
    (r"(?i)https?://(?:(?:www|old|np)\.)?reddit\.com/(?:user|u)/[A-Za-z0-9_-]+/?[^\s<>()\]]*", "[REDDIT USER]"),
    (r"(?i)https?://[^\s<>()\]]*(?:reddit\.com|redd\.it)[^\s<>()\]]*", "[REDDIT LINK]"),
    (r"(?iU)(?<![\w/])/?u/[A-Za-z0-9_-]{3,20}\b", "[REDDIT USER]"),
    (r"(?iU)\bt[1-6]_[a-z0-9]{5,}\b", "[REDDIT ID]"),
]
SPEAKER = r"\[(?:HUMAN|OTHER[^\]]*)\]:"
QUOTES = r"(?:(?:&gt;|>)\s*)+"
QUESTION_START = (
    r"(?iU)^\s*(?:what|which|who|whom|whose|when|where|why|how|is|are|am|was|were|"
    r"do|does|did|can|could|would|should|will|have|has|had)\b"
)
ASSISTANT_SIGNALS = [
    r"(?iU)\b(?:here(?:'s| is)|overall|in summary|recommendation|breakdown|for casual players|for more dedicated players|worthwhile experience)\b",
    r"(?m)(?:^|\n)\s*\d+\.\s+\*{0,2}[A-Za-z]",
    r"(?iU)^\s*[A-Z0-9][^.?!:\n]{0,120}\b(?:is|are|was|were|means|refers to|features|offers|has|includes|can be)\b",
]
#: Line ends of the Unicode line-breaking set, as str.splitlines has them.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
#: White space of str.split: Unicode White_Space and the four separators U+001C..U+001F.
SPACES = r"(?U)[\s\x1c-\x1f]+"
#: The same characters one by one: White_Space, and besides it the four separators.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
SPACE_CHARS = WHITE_SPACE + "\x1c\x1d\x1e\x1f"
WORD = r"(?U)\b[\w']+\b"


def _col(text: str | Column) -> Column:
    return F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit(""))


def bind(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: str | Column) -> Column:
    """Without white space (Unicode) at either end. Trimmed by characters: a pattern would be tried at every place of the text."""
    return F.btrim(_col(text), F.lit(SPACE_CHARS))


def blank(text: str | Column) -> Column:
    """Whether there is nothing but white space (Unicode); looks no further than the first other character."""
    return F.ltrim(_col(text), F.lit(SPACE_CHARS)) == ""


def chat_text(content: str | Column) -> Column:
    """Text of chat-shaped content, given as JSON or plain text.

    An array gives its trimmed non-empty parts by line; an object its ``text``, else its
    ``content``, else itself. Anything else is the text as it stands.
    """
    raw = _col(content)
    value = F.try_parse_json(raw)
    kind = F.schema_of_variant(value)
    part = lambda v: F.coalesce(
        F.try_variant_get(v, "$.text", "string"), F.try_variant_get(v, "$.content", "string"), F.try_variant_get(v, "$", "string"), F.lit("")
    )
    items = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda v: F.trim(part(v)))
    joined = F.array_join(F.filter(items, lambda x: x != ""), "\n")
    named = F.coalesce(F.try_variant_get(value, "$.text", "string"), F.try_variant_get(value, "$.content", "string"), raw)
    return F.when(F.startswith(kind, F.lit("ARRAY")), joined).when(F.startswith(kind, F.lit("OBJECT")), named).otherwise(raw)


def unescape_entities(text: str | Column) -> Column:
    """Entities decoded up to three times; a backslash before five of them is dropped first. All inside the JVM."""
    bare = F.regexp_replace(_col(text), r"\\(?=&(?:gt|lt|amp|quot|apos);)", "")
    return decoded(bare, 3)


def strip_quotes(text: str | Column) -> Column:
    """Quote and indentation marks removed line by line; a last line end is lost."""
    lines = F.split(_col(text), LINE_END, -1)
    lines = F.when((F.size(lines) > 1) & (F.element_at(lines, -1) == ""), F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)

    def clean(line: Column) -> Column:
        line = F.regexp_replace(line, rf"^[ \t]+({SPEAKER})", "$1")
        said = F.regexp_extract(line, rf"(?s)^({SPEAKER})\s*{QUOTES}(.*)$", 2)
        speaker = F.regexp_extract(line, rf"(?s)^({SPEAKER})\s*{QUOTES}(.*)$", 1)
        spoken = F.when(said == "", speaker).otherwise(F.concat(speaker, F.lit(" "), said))
        return F.when(speaker != "", spoken).otherwise(F.regexp_replace(line, rf"^{QUOTES}", ""))

    return F.array_join(F.transform(lines, clean), "\n")


def redact(text: str | Column) -> Column:
    """Trimmed, with links, mentions and ids replaced, specific patterns first."""
    out = strip(text)
    for pattern, mark in REDACTIONS:
        out = F.regexp_replace(out, pattern, mark.replace("$", r"\$"))
    return out


def unusable_speaker(speaker: str | Column) -> Column:
    name = F.lower(strip(speaker))
    return name.isin(UNUSABLE_SPEAKERS) | (name == AUTOMOD) | F.endswith(name, F.lit("bot"))


def unusable_text(text: str | Column) -> Column:
    return F.lower(strip(text)).isin(UNUSABLE_TEXTS)


def context_text(text: str | Column) -> Column:
    """Text of a comment that is shown only as context."""
    low = F.lower(strip(text))
    return (
        F.when(low.isin("[deleted]", "deleted"), "[deleted]")
        .when(low.isin("[removed]", "removed"), "[removed]")
        .when(low.isin("", "none", "null"), "[unavailable comment]")
        .otherwise(redact(text))
    )


def context_label(speaker: str | Column, text: str | Column) -> Column:
    name, low = F.lower(strip(speaker)), F.lower(strip(text))
    return (
        F.when(low.isin("[deleted]", "deleted"), "OTHER - DELETED")
        .when(low.isin("[removed]", "removed"), "OTHER - REMOVED")
        .when(name == AUTOMOD, "OTHER - AUTOMOD")
        .when(F.endswith(name, F.lit("bot")), "OTHER - BOT")
        .when(name.isin(UNUSABLE_SPEAKERS), "OTHER - DELETED USER")
        .otherwise("OTHER - UNAVAILABLE USER")
    )


def opening_text(title: str | Column, body: str | Column) -> Column:
    """Title and body by a blank line if both are there and differ, else the one there is."""
    head, rest = redact(title), F.when(unusable_text(body), F.lit("")).otherwise(redact(body))
    both = (head != "") & (rest != "") & (head != rest)
    return F.when(both, F.concat_ws("\n\n", head, rest)).otherwise(F.when(rest != "", rest).otherwise(head))


def normalise_space(text: str | Column) -> Column:
    return F.btrim(F.regexp_replace(_col(text), SPACES, " "))


def _space_words(text: Column) -> Column:
    plain = normalise_space(text)
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def first_words(text: str | Column, n: int, mark: str = "") -> Column:
    words = _space_words(_col(text))
    return F.when(F.size(words) <= n, _col(text)).otherwise(F.concat(F.array_join(F.slice(words, 1, n), " "), F.lit(mark)))


def last_words(text: str | Column, n: int) -> Column:
    words = _space_words(_col(text))
    return F.when(F.size(words) <= n, _col(text)).otherwise(F.array_join(F.slice(words, -n, n), " "))


def strip_role_mark(text: str | Column) -> Column:
    """One role marker removed from the end."""
    mark = "[HUMAN]:"
    cut = lambda t: F.rtrim(F.substring(t, F.lit(1), F.char_length(t) - len(mark)))
    return bind(F.rtrim(_col(text), F.lit(WHITE_SPACE)), lambda t: F.when(F.endswith(t, F.lit(mark)), cut(t)).otherwise(t))


def strip_role_prefix(text: str | Column) -> Column:
    return strip(F.regexp_replace(_col(text), r"(?i)\A\s*\[(?:HUMAN|OTHER)\]\s*:\s*", ""))


def sanitise(text: str | Column) -> Column:
    """Without C0 controls other than tab, line feed and carriage return."""
    return F.regexp_replace(_col(text), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def word_count(text: str | Column) -> Column:
    return F.regexp_count(_col(text), F.lit(WORD))


def folded_words(text: str | Column) -> Column:
    """Words for copy scans; lower case with sharp s as ss."""
    return F.transform(F.regexp_extract_all(_col(text), F.lit(WORD), F.lit(0)), lambda w: F.replace(F.lower(w), F.lit("ß"), F.lit("ss")))


def excerpt(text: str | Column, most: int = 220, inside: bool = True) -> Column:
    """White space collapsed; longer texts cut, with dots inside the limit or after it."""
    plain = normalise_space(text)
    cut = F.rtrim(F.substring(plain, 1, most - 3)) if inside else F.substring(plain, 1, most)
    return F.when(F.char_length(plain) <= most, plain).otherwise(F.concat(cut, F.lit("...")))


def question_like(text: str | Column) -> Column:
    plain = strip_role_prefix(text)
    return (plain != "") & (F.contains(plain, F.lit("?")) | F.rlike(plain, F.lit(QUESTION_START)))


def assistant_like(truth: str | Column, candidate: str | Column) -> Column:
    """A long lecturing answer where the truth was a question."""
    t, c = strip_role_prefix(truth), strip_role_prefix(candidate)
    signal = F.rlike(c, F.lit(ASSISTANT_SIGNALS[0]))
    for pattern in ASSISTANT_SIGNALS[1:]:
        signal = signal | F.rlike(c, F.lit(pattern))
    long = word_count(c) >= F.greatest(F.lit(24), word_count(t) * 3)
    return (t != "") & (c != "") & question_like(t) & ~question_like(c) & long & signal


def channel_name(name: str | Column) -> Column:
    """Lower-case channel name without archive or path prefixes."""
    low = F.lower(strip(name))
    return F.regexp_replace(F.regexp_replace(low, r"\A/?r/", ""), r"\Asubreddit-", "")
