"""The pipeline's stages on planted, null, empty and repeated rows, with clashing columns."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from anamnesis.llm import common, mixing, ngram_join, queries, token_output, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long, key string, _key string, _copy int, _its_id long, id string, t string, u string, n int, row int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "k", "k", 77, 78, "i", "t", "u", 5, 6) for i, t, s in rows], DOC)


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 500)) for _ in range(n))


BLANK = [(1, None, "a"), (2, "", "a"), (3, " \n", None), (None, None, "a"), (None, "", None)]


@pytest.fixture
def sf_dir(spark, tmp_path):
    items = [(1, prose(99, 20)), (2, "two words"), (3, None), (4, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def kept(df):
    return sorted([(r.doc_id, r.text) for r in df.collect()], key=str)


def test_near_duplicates_stage(spark, sf_dir):
    base = prose(1, 60)
    near = base.replace(base.split()[30], "changed")
    rows = BLANK + [(10, base, "a"), (11, near, "b"), (12, base, "a"), (13, prose(2, 40), "a"), (13, prose(2, 40), "a"), (13, prose(3, 40), "a"), (None, base, "a"), (None, prose(4, 30), "a"), (None, prose(4, 30) + " more", "a"), (14, "one", "a"), (15, "one", "a")]
    docs = table(spark, rows)
    out = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir)
    assert out.schema == docs.schema
    got = kept(out)
    nulls = [t for i, t in got if i is None and t]
    assert len(nulls) == 1 and nulls[0].startswith(prose(4, 30))
    assert [x for x in got if x[0] is not None or not x[1]] == sorted([(i, t) for i, t, _ in BLANK] + [(10, base), (13, prose(2, 40)), (13, prose(3, 40)), (14, "one")], key=str)
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), sf_dir).count() == 0


def test_decontamination_stage(spark, sf_dir):
    passage = " ".join(prose(99, 20).split()[3:17])
    long = prose(5, 2000) + " " + passage.upper() + ", " + prose(6, 2000)
    rows = BLANK + [(10, long, "a"), (11, prose(7, 300), "a"), (None, passage, "a"), (None, prose(8, 50), "a"), (12, "only two words", "a"), (13, "two words " + prose(9, 100), "a"), (14, passage, "a"), (14, prose(10, 20), "a")]
    docs = table(spark, rows)
    out = corpus_pipeline.drop_contaminated(spark, docs, sf_dir)
    assert out.schema == docs.schema
    want = [(i, t) for i, t, _ in BLANK] + [(11, prose(7, 300)), (None, prose(8, 50)), (13, "two words " + prose(9, 100)), (14, prose(10, 20))]
    assert kept(out) == sorted(want, key=str)
    assert corpus_pipeline.drop_contaminated(spark, docs.limit(0), sf_dir).count() == 0


def test_mixing_stage_keeps_clashing_columns(spark, sf_dir):
    rows = BLANK + [(10 + i, prose(i, 50 + i), "ab"[i % 2]) for i in range(20)] + [(10, prose(0, 50), "a")]
    docs = table(spark, rows)
    out = corpus_pipeline.mix_sources(spark, docs, sf_dir)
    got = out.collect()
    assert out.schema == docs.schema
    assert {(r["_copy"], r["_its_id"], r["key"]) for r in got} == {(77, 78, "k")}
    assert sum(len(r.text.split()) for r in got) == sum(r.taken for r in mixing.mix_counts(mixing.mix(docs)).collect())
    assert corpus_pipeline.mix_sources(spark, docs.limit(0), sf_dir).count() == 0


def test_token_output_stage(spark, sf_dir):
    docs = table(spark, BLANK + [(10, prose(1, 50), "a"), (10, prose(1, 50), "a")])
    out = corpus_pipeline.write_tokens(spark, docs, sf_dir).collect()
    assert sorted(r.slot for r in out) == list(range(len(out)))
    assert sum(r.n_tokens for r in out) > 200
    assert corpus_pipeline.write_tokens(spark, docs.limit(0), sf_dir).count() == 0


def test_stages_take_texts_in_batches_of_bounded_size(spark, sf_dir):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], names=["n"])

    machine = toxicity.Machine(np.zeros(toxicity.SYMBOLS**3, np.float32), -1.0)
    path = queries.tokenizer_path("byte_bpe_50k.tiktoken")
    text = F.concat(F.col("id").cast("string"), F.lit(" "), F.repeat(F.lit("word "), 1600))
    for operator in (
        lambda docs: toxicity.keep_clean(docs, machine),
        lambda docs: ngram_join.profile(docs, "doc_id", "text"),
        lambda docs: mixing.mixed_documents(docs, mixing.mix(docs)),
        lambda docs: token_output.materialise(docs, path),
    ):
        own = spark.newSession()  # its settings are its own
        docs = own.range(0, 1500, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("s").alias("source"))
        assert operator(docs).count()
        got = [r.n for r in docs.select("text").mapInArrow(sizes, "n long").collect()]
        assert sum(got) > 12_000_000 and max(got) < 4_000_000


def test_powers_are_kept_for_the_longest_block_only():
    common._powers[:] = [np.ones(1, np.uint64)] * 2
    data = np.frombuffer(b"word " * (common.BLOCK_BYTES // 5), np.uint8)
    starts = np.arange(0, len(data), 5)
    small = common.span_hashes(data, starts, starts + 4)
    assert sum(p.nbytes for p in common._powers) <= 32 * (len(data) + 1)
    long = np.frombuffer(b"x" * (3 << 20), np.uint8)  # one word: tables grow, names stay
    common.span_hashes(long, np.array([0]), np.array([len(long)]))
    assert (common.span_hashes(data, starts, starts + 4) == small).all() and len(set(small.tolist())) == 1
