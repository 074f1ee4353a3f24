"""Agent files that a model reads (S40 to S43): chunks for its prompts, and its answers as atoms. JVM expressions but for the model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import agent_file
from .providers import Judge, judged

CHUNK_BYTES, LEAST_BYTES, MOST_BYTES, MOST_SLUG, EXEMPLARS = 24_000, 12, 1_800, 48, 6
PROMPT = (
    "Below is a file of instructions for an agent. Answer with a JSON array alone. Its elements are objects, one for each separate instruction or fact: "
    'content (text that makes sense alone), type (semantic, procedural or anti_pattern), section (its heading), and, for rules of one activity, trigger (a kebab-case name) and exemplars (requests that enter it).\n\n'
)


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def trigger_slug(c: Column) -> Column:
    """ASCII letters and digits, lower-cased, other runs as one dash; null if nothing is left, if it is longer than 48 or `always`."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), r"^-|-\z", "")
    return F.when((s != "") & (F.length(s) <= MOST_SLUG) & (s != "always"), s)


def chunks(files: DataFrame, most: int = CHUNK_BYTES) -> DataFrame:
    """files: path, value. Chunks: path, chunk, text.

    A chunk ends before a heading line that would carry it past `most` bytes, and after any line that carries it past twice
    as many. Files of up to `most` bytes stay as they are; null is empty; a blank last chunk of a longer one goes.
    """
    value = F.coalesce("value", F.lit(""))
    lines = F.transform(F.split(F.regexp_replace(value, r"\n\z", ""), "\n"), lambda x: F.regexp_replace(x, r"\r\z", ""))
    start = F.struct(F.lit(0).alias("i"), F.lit(0).cast("long").alias("size"), F.array().cast("array<int>").alias("cuts"))

    def step(s: Column, line: Column) -> Column:
        n = F.octet_length(line)
        before = (s["size"] > 0) & (s["size"] + n > most) & F.startswith(line, F.lit("#"))
        size = F.when(before, F.lit(0)).otherwise(s["size"]) + n + 1
        after = size > 2 * most
        new = F.concat(F.when(before, F.array(s["i"])).otherwise(F.array().cast("array<int>")), F.when(after, F.array(s["i"] + 1)).otherwise(F.array().cast("array<int>")))
        return F.struct((s["i"] + 1).alias("i"), F.when(after, F.lit(0)).otherwise(size).cast("long").alias("size"), F.concat(s["cuts"], new).alias("cuts"))

    cut = files.select("path", value.alias("value"), lines.alias("lines")).withColumn("cuts", F.aggregate("lines", start, step, lambda s: s["cuts"]))
    spans = F.arrays_zip(F.concat(F.array(F.lit(0)), "cuts").alias("a"), F.concat("cuts", F.array(F.size("lines"))).alias("b"))
    pieces = F.transform(spans, lambda s: F.concat(F.array_join(F.slice("lines", s["a"] + 1, s["b"] - s["a"]), "\n"), F.lit("\n")))
    pieces = F.when(F.octet_length("value") <= most, F.array("value")).otherwise(pieces)
    out = cut.select("path", F.posexplode(pieces).alias("chunk", "text"), (F.octet_length("value") <= most).alias("whole"), F.size("cuts").alias("last"))
    return out.where(F.col("whole") | (F.col("chunk") < F.col("last")) | (trimmed(F.col("text")) != "")).select("path", "chunk", "text")


def _text_of(item: str, name: str) -> Column:
    """The field, if it is a string."""
    return F.expr(f"CASE WHEN schema_of_variant(try_variant_get({item}, '$.{name}', 'variant')) = 'STRING' THEN try_variant_get({item}, '$.{name}', 'string') END")


def atoms(answers: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Model answers as atoms: the keys, and place, part, section, content, memory_type, tags.

    The array is read from the first `[` to the last `]`; if that is no JSON, whatever is whole before the last `}`. Elements
    without a text of 12 bytes or more go; content is cut to 1,800 bytes. An element with a trigger is followed (part 1 on) by
    its exemplars of 4 to 400 bytes among the first six. No array, or null, gives no rows; nor do objects that repeat a key.
    """
    tail = F.expr(f"CASE WHEN instr(`{column}`, '[') > 0 THEN substring(`{column}`, instr(`{column}`, '[')) END")
    rows = answers.select(*keys, tail.alias("_tail"))

    def until(mark: str) -> str:
        return f"left(_tail, length(_tail) - length(substring_index(_tail, '{mark}', -1)))"

    found = F.expr(f"coalesce(try_variant_get(try_parse_json({until(']')}), '$', 'array<variant>'), try_variant_get(try_parse_json(concat({until('}')}, ']')), '$', 'array<variant>'))")
    rows = rows.select(*keys, F.posexplode(found).alias("place", "_item"))
    kind, slug = _text_of("_item", "type"), F.coalesce(text.slug(_text_of("_item", "section")), F.lit(""))
    rows = rows.select(
        *keys, "place", trimmed(_text_of("_item", "content")).alias("_content"), slug.alias("_section"), trigger_slug(_text_of("_item", "trigger")).alias("_trigger"),
        F.when(kind.isin("procedural", "anti_pattern"), kind).otherwise("semantic").alias("_kind"),
        F.slice(F.expr("coalesce(try_variant_get(_item, '$.exemplars', 'array<variant>'), cast(array() AS array<variant>))"), 1, EXEMPLARS).alias("_examples"),
    ).where(F.octet_length("_content") >= LEAST_BYTES)
    tags = F.array_compact(F.array(F.when(F.col("_section") != "", F.concat(F.lit("section:"), "_section")), F.concat(F.lit("trigger:"), "_trigger")))
    own = F.struct(F.col("_section").alias("section"), text.byte_prefix(F.col("_content"), MOST_BYTES).alias("content"), F.col("_kind").alias("memory_type"), tags.alias("tags"))
    examples = F.expr("filter(transform(_examples, x -> CASE WHEN schema_of_variant(x) = 'STRING' THEN regexp_replace(try_variant_get(x, '$', 'string'), '(?U)^\\\\s+|\\\\s+\\\\z', '') END), x -> octet_length(x) BETWEEN 4 AND 400)")
    more = F.transform(examples, lambda x: F.struct(F.lit("").alias("section"), x.alias("content"), F.lit("semantic").alias("memory_type"), F.array(F.concat(F.lit("mode-exemplar:"), F.col("_trigger"))).alias("tags")))
    every = F.when(F.col("_trigger").isNull(), F.array(own)).otherwise(F.concat(F.array(own), more))
    return rows.select(*keys, "place", F.posexplode(every).alias("part", "_atom")).select(*keys, "place", "part", "_atom.*")


def read_by_model(files: DataFrame, judge: Judge) -> DataFrame:
    """Atoms of each file as the model gives them: path, section, content, memory_type, tags; a file that gets none is read by
    the plain parser. Run it on a written table if the model's answers may differ between runs."""
    answered = judged(chunks(files), F.concat(F.lit(PROMPT), F.col("text")), judge, "answer")
    names = ["path", "section", "content", "memory_type", "tags"]
    read = atoms(answered, ["path", "chunk"], "answer").select(*names)
    return read.union(agent_file.plan(files.join(read.select("path").distinct(), "path", "left_anti")).select(*names))
