"""Token sequences with masks over the text that is to be learned.

Texts and character places are columns; only the tokenizer itself runs in Python, on Arrow batches,
as a hook. Masks, windows and pads are arrays of the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from palaver.operators.prompts import chat_template

#: ``hook(texts)``: for each text its token ids and the (first, behind last) characters of each token.
Hook = Callable[[list[str]], list[tuple[list[int], list[tuple[int, int]]]]]

#: Bytes of text that a hook gets at once (a longer text alone): ids and offsets are Python objects, some 50 times a text's size.
TEXT_AT_ONCE = 1 << 18

# The mark that ends a turn, and what some templates put before a reply.
TURN_END = "<|im_end|>"
EMPTY_PREFILLS = ["<think>\n\n</think>\n\n", "<think>\n</think>\n\n", "<think></think>\n\n", "<think>\n\n</think>", "<think></think>"]


def conversation_text(messages: Column) -> Column:
    """All messages in the plain template, without a header for a further reply."""
    parts = F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit(TURN_END + "\n")))
    return F.array_join(parts, "")


def without_prefill(text: Column) -> Column:
    """The text without an empty thinking block at its end."""
    out = text
    for prefill in reversed(EMPTY_PREFILLS):
        cut = F.substring(text, F.lit(1), F.char_length(text) - len(prefill))
        out = F.when(F.endswith(text, F.lit(prefill)), cut).otherwise(out)
    return out


def _checked(value: Column, broken: Column, message: str) -> Column:
    return F.when(broken, F.raise_error(F.lit(message)).cast("string")).otherwise(value)


def learning_texts(rows: DataFrame, messages: str, prompt: Column | None = None, full: Column | None = None) -> DataFrame:
    """full_text, and the characters begin_char to end_char of it that are to be learned.

    ``messages``: array of (role, content), the last of the assistant. ``prompt`` and ``full`` are the rendered
    texts, by the plain template if not given. The span reaches from the prompt to the last turn's
    end mark. No message, another last role, a prompt that the full text does not begin with,
    and an empty span are errors.
    """
    m = F.col(messages)
    said = F.slice(m, F.lit(1), F.greatest(F.size(m) - 1, F.lit(0)))
    prompt = chat_template(said) if prompt is None else prompt
    full = conversation_text(m) if full is None else full
    last = F.element_at(m, -1)["role"]
    out = rows.withColumn("_last", F.when(F.size(m) > 0, last).otherwise(F.lit("")))
    out = out.withColumn("full_text", _checked(full, F.coalesce(F.col("_last"), F.lit("")) != "assistant", "the last message must be the assistant's"))
    out = out.withColumn("_prefix", without_prefill(prompt))
    out = out.withColumn("full_text", _checked(F.col("full_text"), ~F.startswith("full_text", "_prefix"), "the full text does not begin with the prompt"))
    begin = F.char_length("_prefix")
    rest = F.substring(F.col("full_text"), begin + 1, F.char_length("full_text"))
    # the last end mark in the rest; texts before it may hold others
    tail = F.char_length(F.substring_index(rest, TURN_END, -1))
    end = F.when(F.contains(rest, F.lit(TURN_END)), F.char_length("full_text") - tail - len(TURN_END)).otherwise(F.char_length("full_text"))
    out = out.withColumn("begin_char", begin).withColumn("end_char", end)
    out = out.withColumn("full_text", _checked(F.col("full_text"), F.col("end_char") <= F.col("begin_char"), "the span to learn is empty"))
    return out.drop("_last", "_prefix")


def boundary(offsets: np.ndarray, chars: int) -> int:
    """The first token that reaches beyond so many characters; all tokens, if none does."""
    beyond = (offsets[:, 0] >= chars) | (offsets[:, 1] > chars)
    return int(beyond.argmax()) if beyond.any() else len(offsets)


def _parts(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """The batch in stretches of rows with about ``TEXT_AT_ONCE`` bytes of text."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, n in enumerate(size.tolist()):
        if i > start and held + n > TEXT_AT_ONCE:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if batch.num_rows:
        yield batch.slice(start)


def tokenised(rows: DataFrame, text: str, hook: Hook, bounds: dict[str, str]) -> DataFrame:
    """``rows`` with ``input_ids`` and, for each name of ``bounds``, the token boundary of that column's characters.

    The text is tokenised once, whole; a boundary inside a token lies before it. The hook gets the texts
    of ``TEXT_AT_ONCE`` bytes at once, however many rows an Arrow batch has.
    """
    added = [StructField("input_ids", ArrayType(IntegerType(), False)), *[StructField(name, IntegerType()) for name in bounds]]
    schema = StructType([*rows.schema.fields, *added])
    kinds = [to_arrow_type(f.dataType) for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _parts(whole, text)):
            found = hook(batch.column(text).to_pylist())
            if len(found) != batch.num_rows:
                raise RuntimeError(f"{len(found)} results for {batch.num_rows} texts")
            offsets = [np.array(o, np.int64).reshape(-1, 2) for _, o in found]
            cols = [[ids for ids, _ in found]]
            cols += [[boundary(o, c) for o, c in zip(offsets, batch.column(chars).to_pylist())] for chars in bounds.values()]
            arrays = [*batch.columns, *[pa.array(c, k) for c, k in zip(cols, kinds)]]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, *[f.name for f in added]])

    return rows.mapInArrow(run, schema)


def learning_tokens(rows: DataFrame, hook: Hook) -> DataFrame:
    """``learning_texts`` rows with input_ids, begin, end (tokens) and completion_mask. An empty token span is an error."""
    out = tokenised(rows, "full_text", hook, {"begin": "begin_char", "end": "end_char"})
    mask = F.transform("input_ids", lambda _, i: ((i >= F.col("begin")) & (i < F.col("end"))).cast("int"))
    broken = F.raise_error(F.lit("the span to learn has no token")).cast("array<int>")
    return out.withColumn("completion_mask", F.when(F.col("end") <= F.col("begin"), broken).otherwise(mask))


def cut(prefix: Column, target: Column, most: int) -> tuple[Column, Column]:
    """Prefix and target of ``most`` tokens together: the target loses its end, then the prefix its beginning."""
    target = F.slice(target, F.lit(1), F.lit(most))
    room = F.lit(most) - F.size(target)
    start = F.greatest(F.size(prefix) - room, F.lit(0)) + 1
    return F.slice(prefix, start, room), target


def padded(rows: DataFrame, batch: list[str], prefix: str, target: str, pad: int, most: int | None = None) -> DataFrame:
    """Batches as rectangles: prefixes padded on the left, targets on the right.

    Adds input_ids, attention_mask, position_ids (from 0 at the first real token; 0 before), responses
    and response_mask. The widths are the batch's largest, after ``cut`` to ``most`` tokens. A blank
    target is an error.
    """
    p, t = (F.col(prefix), F.col(target)) if most is None else cut(F.col(prefix), F.col(target), most)
    held = rows.withColumn("_p", p).withColumn("_t", F.when(F.size(F.col(target)) == 0, F.raise_error(F.lit("a target has no token")).cast("array<int>")).otherwise(t))
    width = held.groupBy(*batch).agg(F.max(F.size("_p")).alias("_wp"), F.max(F.size("_t")).alias("_wt"))
    joined = held.join(width, batch)
    fill = lambda value, n: F.array_repeat(F.lit(value), n)
    left, right = F.col("_wp") - F.size("_p"), F.col("_wt") - F.size("_t")
    real = F.size("_p") + F.size("_t")
    before = F.sequence(F.lit(0), left + real - 1)
    positions = F.transform(before, lambda i: F.greatest(i - left, F.lit(0)))
    out = joined.withColumns(
        {
            "input_ids": F.concat(fill(pad, left), "_p", "_t", fill(pad, right)),
            "attention_mask": F.concat(fill(0, left), fill(1, real), fill(0, right)),
            "position_ids": F.concat(positions, F.array_repeat(real - 1, right)),
            "responses": F.concat("_t", fill(pad, right)),
            "response_mask": F.concat(fill(1, F.size("_t")), fill(0, right)),
        }
    )
    return out.drop("_p", "_t", "_wp", "_wt")
