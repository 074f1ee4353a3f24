"""Chunks, model answers and hashed vectors against plain Python; nulls, empty and odd input."""

import json

import numpy as np
from pyspark.sql import functions as F

from anamnesis.sources import model_atoms, providers

DOCS = "/root/testdata/sf0.01/documents.parquet"


def cut(value, most):
    value = value or ""
    if len(value.encode()) <= most:
        return [value]
    lines = value.split("\n")
    lines = [x[:-1] if x.endswith("\r") else x for x in (lines[:-1] if lines[-1] == "" else lines)]
    out, now = [], ""
    for line in lines:
        if now and len((now + line).encode()) > most and line.startswith("#"):
            out.append(now)
            now = ""
        now += line + "\n"
        if len(now.encode()) > 2 * most:
            out.append(now)
            now = ""
    return [*out, now] if now.strip() else out


def test_chunks(spark):
    texts = [None, "", "short", "\n" * 300, "# a\n" + "x" * 90 + "\n# b\ny\r\n\n" + "é" * 150 + "\n", "\n".join(f"{'#' * (i % 3)} line {i}" for i in range(200))]
    files = spark.createDataFrame(list(enumerate(texts)), "path long, value string")
    got = [(r.path, r.chunk, r.text) for r in model_atoms.chunks(files, 100).orderBy("path", "chunk").collect()]
    assert got == [(p, i, c) for p, t in enumerate(texts) for i, c in enumerate(cut(t, 100))]
    assert len(got) > 20
    docs = spark.read.parquet(DOCS).select(F.col("doc_id").alias("path"), F.col("text").alias("value"))
    want = [(r.path, i, c) for r in docs.orderBy("path").collect() for i, c in enumerate(cut(r.value, 500))]
    assert [(r.path, r.chunk, r.text) for r in model_atoms.chunks(docs, 500).orderBy("path", "chunk").collect()] == want
    assert model_atoms.chunks(files.limit(0)).count() == 0


def test_answers(spark):
    long = "ä" * 2000
    items = [{"content": "a rule of style", "type": "procedural", "section": "How To!", "trigger": "Git commit", "exemplars": ["abc", "commit this", 5, "  push it ", "x" * 401, "five", "seventh one"]}, {"content": "tiny"}, {"content": 123456789012345}, 7, {"content": long, "type": 3}]
    answers = [json.dumps(items, ensure_ascii=False), "sure: " + json.dumps(items[:1]) + " done", json.dumps(items[:2])[:-1] + ', {"content": "nev', "no array", "[", "[{]", None, ""]
    rows = spark.createDataFrame(list(enumerate(answers)), "id long, answer string")
    got = [tuple(r) for r in model_atoms.atoms(rows, ["id"], "answer").orderBy("id", "place", "part").collect()]
    rule = [(0, 0, "how-to", "a rule of style", "procedural", ["section:how-to", "trigger:git-commit"])]
    rule += [(0, i, "", x, "semantic", ["mode-exemplar:git-commit"]) for i, x in enumerate(["commit this", "push it", "five"], 1)]
    assert got == [(0, *r) for r in rule] + [(0, 4, 0, "", "ä" * 900, "semantic", [])] + [(1, *r) for r in rule] + [(2, *r) for r in rule]


def test_files_that_the_model_does_not_read(spark):
    files = spark.createDataFrame([("a", "read this file"), ("b", "# Rules\n- never push to main without review\n")], "path string, value string")

    def judge(prompts):
        return [json.dumps([{"content": "one fact of the file"}]) if "read this" in p else "I cannot" for p in prompts]

    got = {(r.path, r.content) for r in model_atoms.read_by_model(files, judge).collect()}
    assert got == {("a", "one fact of the file"), ("b", "never push to main without review")}


def fnv(data):
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 % 2**64
    return h


def test_hashes(spark):
    texts = ["", "a", "foobar", "naïve ", "x" * 3000, "a", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    out = providers.cache_keys(providers.embedded(rows, "text", providers.FnvEmbedder(300)), "text", "m").orderBy("id").collect()
    assert fnv(b"foobar") == 0x85944171F73967E8
    for r in out:
        raw = (r.text or "").encode()
        assert r.key % 2**64 == fnv(b"m\xff" + raw)
        v = np.array([fnv(i.to_bytes(8, "little") + raw) / 2**64 * 2 - 1 for i in range(300)])
        assert np.allclose(r.embedding, v / np.linalg.norm(v), atol=1e-6)


def test_model_json_is_cleaned(spark):
    answer = 'so: {"memories": [{"content": "c", "memory_type": "semantic", "confidence": 0.9, "tags": ["t"]}, {"content": "d", "confidence": 0.1}]} end'
    rows = spark.createDataFrame([(1, answer), (2, None), (3, "none")], "id int, answer string")
    assert [(r.id, r.content) for r in providers.extracted(rows, "answer").collect()] == [(1, "c")]
