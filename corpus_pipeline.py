"""A corpus pipeline: toxicity, near duplicates, benchmark contamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result to the shared folder
and reads it again as the next one's documents. In every stage an empty table gives an empty one, columns besides doc_id,
text, source and n_chars pass through whatever their names, and rows are told apart by (doc_id, text): rows that agree
in both share every decision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from anamnesis.llm import decontamination, mixing, ngram_join, queries, token_output, toxicity
from anamnesis.llm.common import fresh, table, written

#: Keys that are dropped by a broadcast, at most; beyond, the documents are shuffled.
BROADCAST_KEYS = 200_000
WINDOW, PER_HIT = 13, 20


def key() -> Column:
    """Tells rows apart, without an id too: smaller ids first, null ids last, then by the text."""
    return F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("t"), F.xxhash64(F.lit(7), "text").alias("u"))


def keyed(docs: DataFrame) -> DataFrame:
    """key and text of each row."""
    return docs.select(key().alias("key"), "text")


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The documents whose key is not among keys (a column `key`)."""
    keys = written(keys.select("key").distinct(), "dropped")
    own = fresh(docs.columns, "_key")
    keys = keys.withColumnRenamed("key", own + "_dropped")
    few = keys.count() <= BROADCAST_KEYS
    kept = docs.withColumn(own, key()).join(F.broadcast(keys) if few else keys, F.col(own).eqNullSafe(F.col(own + "_dropped")), "left_anti")
    return kept.drop(own)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what the toxicity machine, trained on the labelled documents, predicts to be toxic.

    A row is judged by its whole text alone, so repeated rows fare alike; null and empty texts are kept.
    """
    return toxicity.keep_clean(docs, queries.toxicity_machine(table(spark, sf_dir, "documents"), spark, sf_dir), threshold=0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of linked documents the one with the smallest id, once.

    Ties and rows without an id go by the text; an id goes before none. Rows that agree in id and text are one document.
    Texts that are null, empty or blank link with nothing, and are kept.
    """
    own = fresh(docs.columns, "_key")
    groups = written(ngram_join.near_duplicates(keyed(docs), percent=75, id_col="key"), "groups")
    kept = without(docs, groups.where(~F.col("component_id").eqNullSafe(F.col("key"))))
    if groups.groupBy("key").count().where("count > 1").limit(1).count():
        kept = kept.withColumn(own, key()).dropDuplicates([own]).drop(own)
    return kept


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a whole window of the benchmark (13 words of an item, side by side), however long they
    are, and those of which shorter items make up a twentieth or more.

    Null and empty texts are kept; so is everything if the benchmark is empty.
    """
    found = decontamination.find(keyed(docs), table(spark, sf_dir, "benchmark"), window=WINDOW, id_col="key", per_hit=PER_HIT)
    return without(docs, found.where(F.col("contaminated") | (F.col("n_hit") >= WINDOW)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes the sources to their target weights.

    A document comes back as the runs of its words that the mixture takes, at most twice; null is a source of its own, the
    last. Null and blank texts have no words to take, and go.
    """
    return mixing.mixed_documents(docs, mixing.mix(docs, weights=(3, 1, 2), scale=1.5, most=2.0))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the mixture as token ids in training order; returns the index of its sequences.

    Every row is written, repeated ones too; a null or empty text is the closing token alone.
    """
    return token_output.materialise(docs, queries.tokenizer_path("byte_bpe_50k.tiktoken"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("mixing", mix_sources), ("token_output", write_tokens)]

#: The first stage is a trained model, and the mixing a pseudorandom draw: SQL cannot express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stages over all documents; the index of the sequences written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
