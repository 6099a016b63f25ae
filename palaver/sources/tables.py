"""Explicit schemas, adapters from raw rows, and sinks."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.functions.scoring import field
from palaver.operators.splits import globally_numbered

MESSAGES = "array<struct<role:string,content:string>>"
ROWS = f"data_source string, prompt {MESSAGES}, reward_model struct<style:string,ground_truth:string>, extra_info map<string,string>"
PERSONAS = "user_id string, persona string"
DIALOGUES = (
    "conversation_id string, user_id string, conversation_type string, conversation_history array<struct<turn:int,role:string,"
    "content:string,if_chosen:boolean,score:double,within_turn_id:int,model_name:string,model_provider:string>>"
)


def _text(*options: Column) -> Column:
    """The first non-blank option, else empty."""
    return F.coalesce(*[F.nullif(F.trim(o), F.lit("")) for o in options], F.lit(""))


def utterances(raw: DataFrame) -> DataFrame:
    """Typed utterances of ``zipjsonl`` lines. Keys fall back; blank counts as missing; a time that does not parse is 0."""
    v = F.try_parse_json("value")
    get = lambda path: field(v, path)
    speaker = F.when(F.startswith(F.schema_of_variant(F.try_variant_get(v, "$.speaker", "variant")), F.lit("OBJECT")), _text(get("speaker.id"), get("speaker.name"))).otherwise(
        _text(get("speaker"), get("user"))
    )
    return raw.select(
        "archive",
        F.col("ingest_seq").alias("seq"),
        _text(get("id"), get("utterance_id")).alias("comment_id"),
        _text(get("conversation_id"), get("root"), get("conversation")).alias("conversation_id"),
        _text(get("reply_to"), F.try_variant_get(v, "$['reply-to']", "string")).alias("parent_id"),
        speaker.alias("speaker"),
        F.coalesce(get("text"), F.lit("")).alias("text"),
        F.coalesce(get("timestamp").try_cast("double"), F.lit(0.0)).alias("ts"),
        _text(get("meta.subreddit")).alias("channel"),
        _text(get("meta.title")).alias("title"),
    )


def conversation_meta(raw: DataFrame) -> DataFrame:
    """conversation_id, channel and title: of the entry's ``meta`` if it has one, else of the entry."""
    v = F.try_parse_json("value")
    pick = lambda name: _text(field(v, f"meta.{name}"), field(v, name))
    return raw.where(F.trim("id") != "").select(F.col("id").alias("conversation_id"), pick("subreddit").alias("channel"), pick("title").alias("title"))


def dialogue_messages(dialogues: DataFrame) -> DataFrame:
    """One row per message of nested dialogues, as ``turns.selected_turns`` takes them."""
    got = dialogues.select("conversation_id", "user_id", F.posexplode("conversation_history").alias("pos", "m"))
    return got.select(
        F.col("conversation_id").alias("conv_id"), "user_id", "pos", "m.turn", "m.role", "m.content", F.col("m.if_chosen").alias("chosen"), "m.score", F.col("m.within_turn_id").alias("within")
    )


def from_objects(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A DataFrame of in-memory objects under an explicit schema."""
    return spark.createDataFrame(rows, schema)


def read_personas(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, persona) of .json (object or list) or .jsonl; the last of equal ids counts.

    An empty path gives no rows; another suffix is an error.
    """
    if not path:
        return spark.createDataFrame([], PERSONAS)
    if path.endswith(".jsonl"):
        lines = spark.read.text(path).where(F.trim("value") != "").withColumn("ord", F.monotonically_increasing_id())
        entries = lines.select("ord", F.parse_json("value").alias("v"))
        entries = entries.select("ord", _text(field(F.col("v"), "user_id"), field(F.col("v"), "id")).alias("user_id"), F.col("v").cast("string").alias("persona"))
    elif path.endswith(".json"):
        whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
        is_list = F.startswith(F.schema_of_variant("v"), F.lit("ARRAY"))
        listed = whole.where(is_list).select(F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("ord", "e"))
        listed = listed.select(F.col("ord").cast("long"), _text(field(F.col("e"), "user_id"), field(F.col("e"), "id")).alias("user_id"), F.to_json("e").alias("persona"))
        named = whole.where(~is_list).select(F.explode(F.try_variant_get("v", "$", "map<string,variant>")).alias("user_id", "e"))
        as_text = F.coalesce(F.when(F.rlike(F.schema_of_variant("e"), F.lit("^STRING|^VARCHAR")), F.try_variant_get("e", "$", "string")), F.to_json("e"))
        entries = listed.unionByName(named.select(F.lit(0).cast("long").alias("ord"), "user_id", as_text.alias("persona")))
    else:
        raise ValueError(f"unknown kind of persona file: {path}")
    return entries.where("user_id != ''").groupBy("user_id").agg(F.max_by("persona", "ord").alias("persona"))


def read_rows(spark: SparkSession, paths: list[str], schema: str = ROWS) -> DataFrame:
    """Several Parquet files in order: ``file_ord`` by place in ``paths``."""
    out = None
    for i, path in enumerate(paths):
        part = spark.read.schema(schema).parquet(path).withColumn("file_ord", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out


def write_roles(rows: DataFrame, path: str, role: str = "role", split: str = "split", max_records: int = 1_000_000) -> None:
    """One folder per role and split; a file holds so many rows at most."""
    rows.write.option("maxRecordsPerFile", max_records).partitionBy(role, split).mode("overwrite").parquet(path)


def write_jsonl(rows: DataFrame, path: str, column: str | None = None) -> None:
    """One JSON object per line: the rows, or a column that holds JSON already."""
    (rows.select(F.to_json(F.struct("*")).alias("value")) if column is None else rows.select(F.col(column).alias("value"))).write.mode("overwrite").text(path)


def metadata(rows: DataFrame, by: list[str], **parameters) -> str:
    """JSON of row counts by ``by`` (a few values) and of the parameters."""
    counts = {"/".join(str(x) for x in r[:-1]): r[-1] for r in rows.groupBy(*by).count().orderBy(*by).collect()}
    return json.dumps({"counts": counts, "parameters": parameters}, sort_keys=True, ensure_ascii=False)


def sibling(path: str, split: str) -> str:
    """The default output for another split: the word train replaced, or a suffix."""
    head, name = os.path.split(path)
    stem, ext = os.path.splitext(name)
    changed = re.sub(r"train(?=$|[_.-])", split, stem)
    return os.path.join(head, (changed if changed != stem else f"{stem}_{split}") + ext)


def archive_paths(folder: str, names: list[str]) -> list[str]:
    """Archives of channels, found whatever their case; up to 20 missing are named."""
    there = {f.lower(): f for f in os.listdir(folder)}
    found, missing = [], []
    for name in names:
        file = there.get(f"{name.lower()}.zip") or there.get(f"{name.lower()}.corpus.zip")
        (found.append(os.path.join(folder, file)) if file else missing.append(name))
    if missing:
        raise FileNotFoundError(f"{len(missing)} archives are missing: {', '.join(missing[:20])}")
    return found


def read_targets(
    rows: DataFrame,
    order: str,
    user: str,
    *,
    offset: int = 0,
    limit: int | None = None,
    user_offset: int = 0,
    users: int | None = None,
    modes: dict[str, str] | None = None,
) -> DataFrame:
    """Target rows by slice, then by users in order of first appearance (``user_ord``, from 1).

    ``modes``: columns and the one value that each row must have there (a null prompt_mode will
    do). A blank user and an offset beyond the end are errors.
    """
    if min(offset, user_offset) < 0 or (limit is not None and limit <= 0):
        raise ValueError("offsets must not be negative and a limit must be positive")
    if offset and rows.count() <= offset:
        raise ValueError(f"offset {offset} is beyond the last row")
    r = globally_numbered(rows, "_r", [order]).where(F.col("_r") >= offset)
    if limit is not None:
        r = r.where(F.col("_r") < offset + limit)
    refuse = lambda text: F.raise_error(F.lit(text)).cast("boolean")
    ok = F.when(F.coalesce(F.trim(F.col(user).cast("string")), F.lit("")) == "", refuse("a row has no user")).otherwise(F.lit(True))
    for name, value in (modes or {}).items():
        wrong = ~F.coalesce(F.col(name) == value, F.lit(name == "prompt_mode"))
        ok = F.when(wrong, refuse(f"a row's {name} is not {value}")).otherwise(ok)
    r = r.where(ok)
    firsts = globally_numbered(r.groupBy(user).agg(F.min("_r").alias("_f")), "user_ord", ["_f"]).withColumn("user_ord", F.col("user_ord") + 1)
    if user_offset and firsts.count() <= user_offset:
        raise ValueError(f"user offset {user_offset} is beyond the last user")
    firsts = firsts.where(F.col("user_ord") > user_offset)
    if users is not None:
        firsts = firsts.where(F.col("user_ord") <= user_offset + users)
    return r.join(firsts.drop("_f"), user).drop("_r")
