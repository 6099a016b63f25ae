"""Personas, prompt messages, conditioning modes and fine-tuning records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.functions.scoring import field
from palaver.functions.text import _col, bind, blank, strip, strip_role_mark

MODES = ["history", "persona", "history_persona"]
# Field names and headers that results must carry.
PERSONA_FIELDS = ["values", "verbal_quirks", "expression_style", "length_prior", "background"]
WRAPPERS = ["persona", "persona_memory", "conditioning_summary", "summary"]
TASK = "Reason about what this person would say next, then write their message."


def persona_text(raw: str | Column) -> Column:
    """Readable persona: wrapper keys first (three deep), then the five fields, else the scalar fields; plain text as it is."""
    return bind(strip(raw), lambda text: bind(_unwrapped(F.try_parse_json(text), 3), lambda value: _readable(value, text)))


def _unwrapped(value: Column, depth: int) -> Column:
    """The value under the first wrapper key, ``depth`` deep; a wrapped string may be JSON itself."""
    for _ in range(depth):

        def inside(v: Column) -> Column:
            inner = F.coalesce(*[F.try_variant_get(v, f"$.{w}", "variant") for w in WRAPPERS])
            return F.struct(v.alias("v"), inner.alias("i"))

        def chosen(s: Column) -> Column:
            parsed = F.try_parse_json(F.try_variant_get(s["i"], "$", "string"))
            return F.when(s["i"].isNull(), s["v"]).otherwise(F.coalesce(parsed, s["i"]))

        value = bind(bind(value, inside), chosen)
    return value


def _titled(name: str, value: Column) -> Column:
    return bind(value, lambda v: F.when(v != "", F.concat(F.lit(f"{name}: "), v)))


def _readable(value: Column, text: Column) -> Column:
    lines = []
    for name in PERSONA_FIELDS:
        got = field(value, name)
        if name == "background":
            got = F.coalesce(got, field(value, "other_personal_cues"))
        lines.append(_titled(name, F.trim(got)))
    fields = F.array_join(F.array_compact(F.array(*lines)), "\n")

    def scalar(e: Column) -> Column:
        plain = ~F.rlike(F.schema_of_variant(e["value"]), F.lit("^(OBJECT|ARRAY)"))
        said = F.trim(F.try_variant_get(e["value"], "$", "string"))
        return F.when(plain & (said != ""), F.concat(e["key"], F.lit(": "), said))

    entries = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))
    other = F.array_join(F.array_compact(F.transform(entries, scalar)), "\n")
    shape = F.schema_of_variant(value)
    return (
        F.when(F.startswith(shape, F.lit("OBJECT")), bind(fields, lambda f: F.when(f != "", f).otherwise(F.coalesce(other, F.lit("")))))
        .when(F.rlike(shape, F.lit("^(VARCHAR|STRING)")), F.try_variant_get(value, "$", "string"))
        .otherwise(text)
    )


def persona_valid(raw: str | Column) -> Column:
    """Whether an induced persona has all five fields as non-blank strings."""
    value = F.try_parse_json(F.regexp_replace(strip(raw), r"(?s)\A```(?:json)?\s*|\s*```\z", ""))
    ok = F.lit(True)
    for name in PERSONA_FIELDS:
        ok = ok & (F.coalesce(F.trim(field(value, name)), F.lit("")) != "")
    return F.coalesce(ok, F.lit(False))


def lookup_persona(rows: DataFrame, personas: DataFrame, keys: list[str]) -> DataFrame:
    """``persona``: the first non-blank text under the row's keys, in turn. personas: user_id, persona."""
    clean = personas.where(F.trim("persona") != "")
    out = rows
    for i, key in enumerate(keys):
        out = out.join(clean.select(F.col("user_id").alias(f"_k{i}"), F.col("persona").alias(f"_p{i}")), F.col(key).cast("string") == F.col(f"_k{i}"), "left").drop(f"_k{i}")
    found = [f"_p{i}" for i in range(len(keys))]
    return out.withColumn("persona", F.coalesce(*found, F.lit(""))).drop(*found)


def history_section(history: str | Column) -> Column:
    return bind(strip(bind(_col(history), _without_source)), _headed)


def _without_source(text: Column) -> Column:
    """Without the source lines; few texts have the mark, and a search for it is much quicker than the pattern."""
    cut = F.regexp_replace(text, r"(?m)^\[THREAD SOURCE\]\s*\n[^\n]*(?:\n+|\z)", "")
    return F.when(F.contains(text, F.lit("[THREAD SOURCE]")), cut).otherwise(text)


def _headed(text: Column) -> Column:
    return (
        F.when(text == "", F.lit(""))
        .when(F.startswith(text, F.lit("[USER HISTORY]")), text)
        .when(F.startswith(text, F.lit("[HISTORICAL CONTEXT]")), F.concat(F.lit("[USER HISTORY]"), F.substring(text, 21, 2**30)))
        .otherwise(F.concat(F.lit("[USER HISTORY]\n"), text))
    )


def _current(context: str | Column) -> Column:
    return F.concat(F.lit("[CURRENT CONTEXT]\n"), strip_role_mark(context))


def _user_message(section: Column, current: Column, mode: Column) -> Column:
    """A section is empty or has other characters than white space."""
    shown = mode.isin("history", "history_persona") & (section != "")
    return F.when(shown, F.concat(section, F.lit("\n\n"), current)).otherwise(current)


def user_message(history: str | Column, context: str | Column, mode: Column) -> Column:
    """History (where the mode has it) and the current context, by a blank line."""
    return bind(history_section(history), lambda past: bind(_current(context), lambda now: _user_message(past, now, mode)))


def system_message(persona: str | Column, mode: Column, task: str = TASK) -> Column:
    text = strip(persona)
    needs = mode.isin("persona", "history_persona")
    checked = F.when(needs & (text == ""), F.raise_error(F.lit("this mode needs a persona"))).otherwise(text)
    return F.when(needs, F.concat(F.lit("[USER PERSONA]\n"), checked, F.lit(f"\n\n{task}"))).otherwise(F.lit(task))


def prompt_messages(history: str | Column, context: str | Column, persona: str | Column, mode: Column, task: str = TASK) -> Column:
    """array<struct<role, content>>: the system and the user message. An unknown mode is an error."""
    return _messages(lambda known: user_message(history, context, known), persona, mode, task)


def _messages(user, persona: str | Column, mode: Column, task: str) -> Column:
    known = F.when(mode.isin(MODES), mode).otherwise(F.raise_error(F.concat(F.lit("unknown mode "), mode)))
    return F.array(
        F.struct(F.lit("system").alias("role"), system_message(persona, known, task).alias("content")),
        F.struct(F.lit("user").alias("role"), user(known).alias("content")),
    )


def chat_template(messages: Column) -> Column:
    """Default plain template: role headers, then a header for the reply."""
    parts = F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n")))
    return F.concat(F.array_join(parts, ""), F.lit("<|im_start|>assistant\n"))


def recondition(rows: DataFrame, mode: str | list[str], task: str = TASK) -> DataFrame:
    """Rows (history, context, persona, ground_truth) rendered again for one mode, or for each of several.

    The rows are read once and the texts' sections made once, however many modes there are.
    """
    modes = [mode] if isinstance(mode, str) else list(mode)
    for m in modes:
        if m not in MODES:
            raise ValueError(f"unknown mode {m}")
    known = F.explode(F.array(*[F.lit(m) for m in modes])) if len(modes) > 1 else F.lit(modes[0])
    out = rows.withColumn("context", strip_role_mark("context")).withColumn("ground_truth", strip("ground_truth"))
    out = out.withColumn("persona", strip("persona"))
    out = out.withColumn("_blank", blank("user_history")).withColumn("_past", history_section("user_history")).withColumn("_now", _current("context"))
    out = out.withColumn("conditioning_mode", known)
    needs = lambda least: F.col("conditioning_mode").isin(least, "history_persona")
    persona = F.when(F.col("persona") == "", F.raise_error(F.lit("blank persona"))).otherwise(F.col("persona"))
    out = out.withColumn("persona", F.when(needs("persona"), persona).otherwise(F.lit("")))
    history = F.when(needs("history") & F.col("_blank"), F.raise_error(F.lit("blank history"))).otherwise
    out = out.withColumn("user_history", history(F.col("user_history"))).withColumn("_past", history(F.col("_past")))
    out = out.withColumn("prompt", _messages(lambda m: _user_message(F.col("_past"), F.col("_now"), m), "persona", F.col("conditioning_mode"), task))
    return out.withColumn("prompt_text", chat_template(F.col("prompt"))).withColumn("raw_prompt", F.to_json("prompt")).drop("_blank", "_past", "_now")


def reasoning_block(trace: str | Column) -> Column:
    """A trace in one pair of tags; blank stays blank."""
    text = strip(trace)
    pair = r"(?is)\A<\s*(?:reasoning|think)\b[^>]*>\s*(.*?)\s*</\s*(?:reasoning|think)\s*>\z"
    inner = F.when(F.rlike(text, F.lit(pair)), F.trim(F.regexp_extract(text, pair, 1))).otherwise(
        F.trim(F.regexp_replace(text, r"(?i)</?\s*(?:reasoning|think)\b[^>]*>", ""))
    )
    return F.when(text == "", F.lit("")).otherwise(F.concat(F.lit("<reasoning>"), inner, F.lit("</reasoning>")))


def sft_record(prompt: Column, response: str | Column, trace: str | Column) -> Column:
    """JSON of the messages with the assistant's turn."""
    said = F.concat(reasoning_block(trace), F.lit("\n[HUMAN]: "), strip(response))
    turn = F.struct(F.lit("assistant").alias("role"), said.alias("content"))
    return F.to_json(F.struct(F.concat(prompt, F.array(turn)).alias("messages")))


def completion_mask(n_prompt: Column, n_total: Column, width: int) -> Column:
    """0/1 over ``width`` tokens: 1 for those after the prompt; longer sequences lose their right end."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: ((i >= n_prompt) & (i < n_total)).cast("int"))
