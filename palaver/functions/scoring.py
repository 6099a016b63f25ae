"""Judge output: lenient JSON, coercions, scores, rewards and format checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palaver.functions.text import _col, bind, strip, word_count

# Weights, bounds and patterns that results must match.
CRITERIA = ["immediate_target_score", "human_goal_score", "communication_style_score"]
PENALTIES = [
    "source_copy_penalty",
    "assistant_like_penalty",
    "wrong_target_or_role_penalty",
    "unsupported_adversarial_reframing_penalty",
]
JUDGE_SCALE, JUDGE_CLIP = 0.9, 5.0
LOW_RATIO, HIGH_RATIO = 0.8, 1.1
SHORT_LAMBDA, LONG_LAMBDA, PENALTY_CAP = 0.35, 0.15, 0.25
SCHEMA_BONUS, TAIL_BONUS = 0.05, 0.05
LOGPROB_LOW, LOGPROB_HIGH = -8.0, 0.0
HUMAN_TAG = r"(?i)\[\s*human\s*\]\s*:"
HUMAN_LINE = r"(?im)^\s*\[HUMAN\]:\s*"
MARKER_LINE = (
    r"(?im)^\s*(?:(?:\(\s*response\s*\)|<\s*human\s*>)(?:\s*:)?|"
    r"\[\s*[a-z][a-z0-9 _-]{0,40}\s*[\]\}](?:\s*:)?|human\s*:)\s*"
)
LATE_REASONING = (
    r"(?im)(?:^|\n)\s*(?:\*{0,2}\s*reasoning\s*\*{0,2}\s*:|##\s*(?:verbal style|personal connection|stance|response type)\b)"
)
OPEN_TAG, CLOSE_TAG = r"(?is)<\s*reasoning\s*>", r"(?is)</\s*reasoning\s*>"
ANY_REASONING = r"(?is)<\s*/?\s*(?:reasoning|think)\b"
XML_TAG = r"(?is)</?\s*[a-zA-Z][^>]*>"
OTHER_TAG = r"(?is)</?\s*(?!reasoning(?![a-zA-Z0-9_-]))[a-zA-Z][^>]*>"
LETTERS = r"(?U)\b[^\W\d_]+\b"


def json_object(text: str | Column) -> Column:
    """The object in judge output: a fenced block, else from the first brace to the last."""
    raw = _col(text)
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    value = F.coalesce(F.try_parse_json(F.nullif(fenced, F.lit(""))), F.try_parse_json(F.nullif(braces, F.lit(""))))
    return bind(value, lambda v: F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), v))


def field(value: Column, path: str) -> Column:
    return F.try_variant_get(value, f"$.{path}", "string")


def number(text: Column) -> Column:
    """A float, or null."""
    return text.try_cast("double")


def unit(value: Column) -> Column:
    # greatest and least skip nulls, so null is kept by hand
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def rounded(value: Column, digits: int = 6) -> Column:
    """Half away from zero at ``digits`` decimals, as SQL engines round a double: of the product, in binary.

    ``F.round`` goes by the shortest decimal, so that 0.5203125, in binary a little less, goes up.
    """
    scaled = value * float(10**digits)
    return F.when(F.abs(scaled) == float("inf"), value).otherwise(F.round(scaled) / float(10**digits))


def truth(text: Column) -> Column:
    """Boolean of a JSON value: words for true, or a number other than zero."""
    low = F.lower(F.btrim(text))
    return F.coalesce(low.isin("true", "yes", "y", "1") | (low.try_cast("double") != 0), F.lit(False))


def gap_rating(gap: Column) -> Column:
    return (
        F.when(gap <= -2.0, 1).when(gap <= -1.0, 2).when(gap <= -0.25, 3).when(gap < 0.25, 4).when(gap < 1.0, 5).when(gap < 2.0, 6).otherwise(7)
    )


def broken_rating(text: str | Column) -> Column:
    """A rating named in text that does not parse, by two patterns in turn; null if none."""
    raw = _col(text)
    first = F.regexp_extract(raw, r'(?i)(?:^|[{\s,\n])"?rating"?\s*[:=]\s*"?([1-7])"?\b', 1)
    second = F.regexp_extract(raw, r'(?i)\bfinal\s+rating\s*(?:is|=|:)?\s*"?([1-7])"?\b', 1)
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(second, F.lit(""))).cast("int")


def json_rating(value: Column, path: str) -> Column:
    """1 to 7, from an integer, a JSON float (cut), true or a string of an integer; null for anything else."""
    text = field(value, path)
    kind = F.schema_of_variant(F.try_variant_get(value, f"$.{path}", "variant"))
    whole = F.when(F.rlike(text, F.lit(r"\A\s*[+-]?\d+\s*\z")), F.btrim(text).try_cast("int"))
    got = F.when(F.rlike(kind, F.lit("^(VARCHAR|STRING)")), whole).when(kind == "BOOLEAN", F.when(text == "true", 1)).otherwise(F.floor(text.try_cast("double")).try_cast("int"))
    return F.when(got.between(1, 7), got)


def pairwise(raw: str | Column, lenient: bool = False) -> Column:
    """struct<score_a, score_b, gap, rating, parse_error> of a pairwise judgement.

    A side scores the sum of its criteria less three times the mean of its penalties, not
    below zero. Without score fields the explicit rating counts. ``lenient``: a criterion
    that is missing counts as zero instead of failing.
    """
    return bind(json_object(raw), lambda value: _pairwise(value, raw, lenient))


def _pairwise(value: Column, raw: str | Column, lenient: bool) -> Column:
    # each field is read once; the arithmetic below works on the bound numbers
    names = [f"{c}_{s}" for s in "ab" for c in CRITERIA] + [f"{p}_{s}" for s in "ab" for p in PENALTIES]
    texts = F.struct(*[field(value, n).alias(n) for n in names], json_rating(value, "rating").alias("explicit"))

    def judged(t: Column) -> Column:
        any_field, bad, total = F.lit(False), F.lit(False), {}
        for s in "ab":
            base, lost = F.lit(0.0), F.lit(0.0)
            for c in CRITERIA:
                got = number(t[f"{c}_{s}"])
                any_field = any_field | t[f"{c}_{s}"].isNotNull()
                bad = bad | got.isNull()
                base = base + F.coalesce(got, F.lit(0.0))
            for p in PENALTIES:
                got = number(t[f"{p}_{s}"])
                bad = bad | (t[f"{p}_{s}"].isNotNull() & got.isNull())
                lost = lost + F.coalesce(unit(got), F.lit(0.0))
            total[s] = F.greatest(F.lit(0.0), base - lost / 4 * 3)
        return F.struct(total["a"].alias("a"), total["b"].alias("b"), any_field.alias("any"), (bad & F.lit(not lenient)).alias("bad"), t["explicit"].alias("explicit"))

    def outcome(j: Column) -> Column:
        failed = value.isNull() | (j["any"] & j["bad"]) | (~j["any"] & j["explicit"].isNull())
        gap = j["b"] - j["a"]
        rating = F.when(value.isNull(), broken_rating(raw)).when(failed, F.lit(None).cast("int")).when(j["any"], gap_rating(gap)).otherwise(j["explicit"])
        zero = lambda c: F.when(failed | ~j["any"], F.lit(0.0)).otherwise(c)
        return F.struct(
            zero(j["a"]).alias("score_a"),
            zero(j["b"]).alias("score_b"),
            zero(gap).alias("gap"),
            rating.cast("int").alias("rating"),
            failed.alias("parse_error"),
        )

    return bind(bind(texts, judged), outcome)


def oriented(rating: Column, generated_is_b: Column, parse_error: Column) -> Column:
    """The generated side's rating: 0 after a parse error."""
    return F.when(parse_error | rating.isNull(), F.lit(0)).otherwise(F.when(generated_is_b, rating).otherwise(8 - rating)).cast("int")


def generated_is_b(user: Column, post: Column, target: Column, response: Column) -> Column:
    """Stable choice of sides: an even digest puts the generated text second."""
    name = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in (user, post, target, response)])
    return F.conv(F.substring(F.sha2(name, 256), 64, 1), 16, 10).cast("int") % 2 == 0


def specificity(raw: str | Column) -> Column:
    """struct<context_specificity, user_evidence_compatibility, overall, parse_error>."""
    return bind(json_object(raw), _specificity)


def _specificity(value: Column) -> Column:
    dims = ["context_specificity", "user_evidence_compatibility"]
    got = [number(field(value, f"{d}.score")) for d in dims]
    mean = (unit(got[0]) + unit(got[1])) / 2
    given = field(value, "overall")
    overall = F.when(given.isNull(), mean).otherwise(unit(number(given)))
    failed = got[0].isNull() | got[1].isNull() | overall.isNull()
    zero = lambda c: F.when(failed, F.lit(0.0)).otherwise(c)
    return F.struct(zero(unit(got[0])).alias(dims[0]), zero(unit(got[1])).alias(dims[1]), zero(overall).alias("overall"), failed.alias("parse_error"))


def similarity(raw: str | Column, hard_flags: bool = True) -> Column:
    """struct<raw_score, score, semantic_similarity, information_completeness, flagged, parse_error>.

    A hard flag zeroes the score and the breakdown; with ``hard_flags`` off the score is
    restored and the breakdown stays as the flag left it.
    """
    whole = F.try_parse_json(_col(raw))
    return bind(bind(whole, lambda v: F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), v)), lambda v: _similarity(v, hard_flags))


def _similarity(value: Column, hard_flags: bool) -> Column:
    score = unit(number(field(value, "score")))
    flagged = truth(field(value, "wrong_perspective")) | truth(field(value, "source_copy"))
    failed = score.isNull() | field(value, "thought").isNull()
    part = lambda name: F.when(flagged, F.lit(0.0)).otherwise(unit(number(field(value, name))))
    final = F.when(flagged & F.lit(hard_flags), F.lit(0.0)).otherwise(score)
    return F.struct(
        F.when(failed, F.lit(0.0)).otherwise(score).alias("raw_score"),
        F.when(failed, F.lit(0.0)).otherwise(final).alias("score"),
        part("semantic_similarity").alias("semantic_similarity"),
        part("information_completeness").alias("information_completeness"),
        (flagged & F.lit(hard_flags) & ~failed).alias("flagged"),
        failed.alias("parse_error"),
    )


def _cut_last(text: Column, pattern: str) -> tuple[Column, Column, Column]:
    """(found, before, after) of the last match of ``pattern``."""
    found = F.regexp_count(text, F.lit(pattern)) > 0
    parts = F.split(text, pattern, -1)
    after = F.element_at(parts, -1)
    before = F.substring(text, F.lit(1), F.char_length(text) - F.char_length(after))
    return found, F.regexp_replace(before, rf"(?s)(?:{pattern})\z", ""), after


def _without_hidden_close(text: Column) -> Column:
    """One closing tag of hidden thinking, alone before the first role tag, is dropped."""
    text = strip(text)
    first = F.regexp_instr(text, F.lit(HUMAN_TAG))
    prefix = F.when(first > 0, F.substring(text, F.lit(1), first - 1)).otherwise(text)
    rest = F.when(first > 0, F.substring(text, first, F.char_length(text))).otherwise(F.lit(""))
    close = r"(?is)</\s*think\s*>"
    alone = (F.regexp_count(prefix, F.lit(OPEN_TAG)) == 0) & (F.regexp_count(prefix, F.lit(close)) == 1)
    return F.when(alone, strip(F.concat(F.regexp_replace(prefix, close, ""), rest))).otherwise(text)


def _plain_response(text: Column) -> Column:
    text = F.regexp_replace(strip(text), r"\A\*{1,2}\s*", "")
    return strip(F.regexp_replace(text, r"(?i)\A(?:(?:\[\s*human\s*\]|<\s*human\s*>)(?:\s*:)?|human\s*:)\s*", ""))


def reasoning_and_response(text: str | Column) -> Column:
    """struct<reasoning, response>: by the last role tag, else response tags, else a marker line, else all."""
    raw = _without_hidden_close(_col(text))
    found, before, after = _cut_last(raw, HUMAN_TAG)
    by_tag = F.struct(
        strip(F.regexp_replace(strip(before), r"(?i)<response\s*>\z", "")).alias("reasoning"),
        _plain_response(F.regexp_replace(strip(after), r"(?i)</response\s*>\z", "")).alias("response"),
    )
    closed = r"(?is)\A(.*?)<\s*response\s*>(.*?)</\s*response\s*>\s*\z"
    inline = r"(?is)<\s*response\s*>(.*?)</\s*response\s*>"
    opened = r"(?is)<\s*response\s*>"
    at_inline, at_open = F.regexp_instr(raw, F.lit(inline)), F.regexp_instr(raw, F.lit(opened))
    head = lambda at: strip(F.substring(raw, F.lit(1), F.greatest(at - 1, F.lit(0))))
    tail = F.regexp_replace(F.substring(raw, at_open, F.char_length(raw)), r"(?is)\A<\s*response\s*>", "")
    tail = F.regexp_replace(tail, r"(?is)</\s*response\s*>\z", "")
    by_response = (
        F.when(
            F.rlike(raw, F.lit(closed)),
            F.struct(strip(F.regexp_extract(raw, closed, 1)).alias("reasoning"), _plain_response(F.regexp_extract(raw, closed, 2)).alias("response")),
        )
        .when(at_inline > 0, F.struct(head(at_inline).alias("reasoning"), _plain_response(F.regexp_extract(raw, inline, 1)).alias("response")))
        .when(at_open > 0, F.struct(head(at_open).alias("reasoning"), _plain_response(tail).alias("response")))
    )
    marked, ahead, behind = _cut_last(raw, MARKER_LINE)
    by_marker = F.struct(strip(ahead).alias("reasoning"), F.regexp_replace(strip(behind), r"\A\*{1,2}\s*", "").alias("response"))
    whole = F.struct(F.lit("").alias("reasoning"), raw.alias("response"))
    return (
        F.when(found & (by_tag["response"] != ""), by_tag)
        .when(by_response.isNotNull(), by_response)
        .when(marked & (by_marker["response"] != ""), by_marker)
        .otherwise(whole)
    )


def format_parts(text: str | Column) -> Column:
    """struct of tag counts and flags of a generation's layout."""
    raw = _without_hidden_close(_col(text))
    opens, closes, humans = (F.regexp_count(raw, F.lit(p)) for p in (OPEN_TAG, CLOSE_TAG, HUMAN_TAG))
    exact, prefix, tail = _cut_last(raw, HUMAN_LINE)
    tail = strip(tail)
    forbidden = F.rlike(raw, F.lit(OTHER_TAG))
    twice, twice_human = (opens > 1) | (closes > 1), humans > 1
    unmatched = opens != closes
    late = F.rlike(tail, F.lit(ANY_REASONING)) | F.rlike(tail, F.lit(LATE_REASONING))
    letters = lambda t: F.rlike(F.regexp_replace(t, XML_TAG, " "), F.lit(LETTERS))
    closed, _, behind = _cut_last(prefix, CLOSE_TAG)
    there = exact & (tail != "")
    return F.struct(
        exact.alias("has_exact_human_prefix"),
        (exact & closed & ~letters(behind)).alias("has_reasoning_schema"),
        (exact & ~letters(prefix)).alias("placeholder_reasoning_prefix"),
        there.alias("response_nonempty"),
        (there & ~late).alias("no_post_human_thinking_trace"),
        opens.alias("reasoning_open_count"),
        closes.alias("reasoning_close_count"),
        humans.alias("human_prefix_count"),
        twice.alias("has_duplicate_reasoning_block"),
        twice_human.alias("has_duplicate_human_prefix"),
        unmatched.alias("has_unmatched_reasoning_tags"),
        forbidden.alias("has_forbidden_xml_tag"),
        (twice | twice_human | unmatched | forbidden).alias("format_hard_fail"),
    )


def format_bonus(parts: Column) -> Column:
    schema = (
        (parts["reasoning_open_count"] == 1)
        & (parts["reasoning_close_count"] == 1)
        & parts["response_nonempty"]
        & parts["has_reasoning_schema"]
        & ~parts["placeholder_reasoning_prefix"]
        & ~parts["has_forbidden_xml_tag"]
    )
    tail = (
        (parts["human_prefix_count"] == 1) & parts["has_exact_human_prefix"] & parts["response_nonempty"] & parts["no_post_human_thinking_trace"]
    )
    return F.when(schema, SCHEMA_BONUS).otherwise(0.0) + F.when(tail, TAIL_BONUS).otherwise(0.0)


def meaningful_thinking(text: str | Column) -> Column:
    """Whether a word stands before the last role tag, tags and labels aside."""
    found, before, _ = _cut_last(_col(text), r"(?i)\[\s*human\s*[\]\}](?:\s*:)?")
    prefix = F.when(found, before).otherwise(_col(text))
    prefix = F.regexp_replace(F.regexp_replace(prefix, r"(?s)<[^>]+>", " "), r"(?is)\[\s*(?:human|other(?:\s*-\s*op)?)\s*\]\s*:?", " ")
    return F.rlike(prefix, F.lit(LETTERS))


def length_penalty(generated_words: Column, human_words: Column) -> Column:
    """Bounded penalty outside the dead band of the length ratio."""
    ratio = generated_words / F.greatest(human_words, F.lit(1))
    short = F.greatest(LOW_RATIO - ratio, F.lit(0.0)) / LOW_RATIO * SHORT_LAMBDA
    long = F.greatest(ratio - HIGH_RATIO, F.lit(0.0)) / HIGH_RATIO * LONG_LAMBDA
    return F.least(short + long, F.lit(PENALTY_CAP))


def pairwise_reward(score: Column, bonus: Column, penalty: Column, response: Column, thinking: Column) -> Column:
    """Zero without thinking; without a response the bonus less the penalty; else the judged reward too."""
    judged = JUDGE_SCALE * (F.least(score.cast("double"), F.lit(JUDGE_CLIP)) - 1.0) / 6.0
    total = F.when(strip(response) == "", bonus - penalty).otherwise(judged + bonus - penalty)
    return F.when(~thinking, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), total))


def logprob_reward(mean: Column, bonus: Column) -> Column:
    return F.greatest(F.lit(LOGPROB_LOW), F.least(F.lit(LOGPROB_HIGH), mean)) + bonus


def similarity_reward(score: Column, bonus: Column, response: Column) -> Column:
    return F.when(strip(response) == "", F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), JUDGE_SCALE * score + bonus))


def words_ratio(generated: str | Column, truth_text: str | Column) -> Column:
    return word_count(generated) / F.greatest(word_count(truth_text), F.lit(1))
