"""Operators that SQL does not express, against plain Python; empty tables, nulls and ties."""

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from anamnesis import turn_queries  # noqa: F401
from anamnesis.functions import text
from anamnesis.operators import analytics, graph, lifecycle, retrieval, turns, upkeep
from anamnesis.queries import QUERIES
from anamnesis.streaming import alerts

ROW = "id long, user_id string, agent_id string, embedding array<double>"


def separate(ids, conflicts):
    left, out = list(ids), []
    while left:
        at = next((i for i, x in enumerate(left) if not out or frozenset((out[-1], x)) not in conflicts), 0)
        out.append(left.pop(at))
    return out


def test_separated(spark):
    pairs = [(1, 2), (2, 3), (5, 4), (1, 6), (98, 99)]
    hits = spark.createDataFrame([(i, i) for i in range(1, 7)], "id long, place int")
    got = turns.separated(hits, spark.createDataFrame(pairs, "a long, b long")).orderBy("place").collect()
    assert [r.id for r in got] == separate(range(1, 7), {frozenset(p) for p in pairs})
    assert turns.separated(hits.limit(0), spark.createDataFrame(pairs, "a long, b long")).count() == 0


def test_byte_prefix(spark):
    texts = ["", "abc", "aé漢𝒳b", "é" * 400, "x" * 301, None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for most in (0, 1, 2, 3, 5, 6, 300):
        got = {r.id: r.p for r in rows.select("id", text.byte_prefix(F.col("t"), most).alias("p")).collect()}
        for i, t in enumerate(texts[:-1]):
            assert got[i] == t.encode()[:most].decode("utf-8", "ignore"), (t, most)


def test_entity_contexts(spark):
    rows = [(i, "u", "a", "é" * (40 * i) + str(i), ["x", "entity: Big Corp "]) for i in range(1, 6)] + [(9, "u", "a", "none", [])]
    m = spark.createDataFrame(rows, "id long, user_id string, agent_id string, content string, tags array<string>")

    def cut(s, n):
        return s.encode()[: max(0, n)].decode("utf-8", "ignore")

    want = None
    for _, _, _, c, _ in rows[:5]:
        if want is None:
            want = cut(c, 300)
        elif len(want.encode()) < 300:
            want += " | "
            want += cut(c, 500 - len(want.encode()))
    assert [(r.entity, r.context) for r in turns.entity_contexts(m).collect()] == [("big corp", want)]


def vectors(spark, n=60):
    rng = np.random.default_rng(1)
    rows = [(i, "u" if i % 5 else "v", "a", rng.standard_normal(4 if i % 9 else 3).tolist()) for i in range(n)]
    rows += [(n, "u", "a", []), (n + 1, "u", "a", [0.0] * 4), (n + 2, None, "a", [1.0] * 4), (n + 3, "u", "a", None), (n + 4, "u", "a", rows[1][3])]
    return rows, spark.createDataFrame(rows, ROW)


def cosine(a, b):
    if len(a) != len(b) or not any(a) or not any(b):
        return 0.0
    return float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))


def test_pairs_meet_in_blocks(spark, monkeypatch):
    rows, m = vectors(spark)
    held = [r for r in rows if r[3] and r[1]]
    want = {(a[0], b[0]) for a in held for b in held if a[0] < b[0] and a[1] == b[1] and cosine(a[3], b[3]) >= 0.4}
    near = {}
    for a in held:
        others = sorted(((-round(cosine(a[3], b[3]), 9), b[0]) for b in held if a[0] != b[0] and a[1] == b[1] and cosine(a[3], b[3]) >= 0.4))
        near[a[0]] = [i for _, i in others[:3]]
    for block in (2000, 4):
        monkeypatch.setattr(lifecycle, "BLOCK", block)
        assert {(r.a, r.b) for r in lifecycle.similar_pairs(m, 0.4).collect()} == want
        got = {}
        for r in sorted(lifecycle.nearest_pairs(m, 3, 0.4).collect(), key=lambda r: (-r.similarity, r.other)):
            got.setdefault(r.id, []).append(r.other)
        assert got == {i: n for i, n in near.items() if n}
    assert lifecycle.similar_pairs(m.limit(0), 0.4).count() == 0


def test_mmr(spark):
    rows, m = vectors(spark)
    hits = [(i, 1.0 - i / 40) for i in range(1, 20) if i % 9]
    got = [r.id for r in analytics.diversified(spark.createDataFrame(hits, "id long, score double"), m, 6, 0.5).orderBy("place").collect()]
    low, high = min(s for _, s in hits), max(s for _, s in hits)
    chosen = []
    while len(chosen) < 6:
        left = [(i, s) for i, s in hits if i not in chosen]
        chosen.append(max(left, key=lambda x: (0.5 * (x[1] - low) / (high - low) - 0.5 * max((cosine(rows[x[0]][3], rows[c][3]) for c in chosen), default=0.0), -x[0]))[0])
    assert got == chosen


def test_bm25_without_terms_or_rows(spark):
    m = spark.createDataFrame([(1, None, "alpha beta beta"), (2, "ctx", ""), (3, None, None), (4, None, "alpha")], "id long, context string, content string")
    assert retrieval.bm25(m, "the of").count() == 0 and retrieval.bm25(m.limit(0), "alpha").count() == 0
    got = {r.id: r.score for r in retrieval.bm25(m, "alpha beta").collect()}
    assert set(got) == {1, 4} and got[1] > got[4]
    only = retrieval.bm25(m, "alpha beta", candidates=m.where("id = 4")).collect()
    assert [(r.id, r.score) for r in only] == [(4, got[4])]  # statistics are of all rows


def test_alerts(spark):
    rng = random.Random(2)
    words = [f"word{i}" for i in range(30)]
    facts = [(i, " ".join(rng.choice(words) for _ in range(6))) for i in range(20)] + [(20, "a b"), (21, ""), (22, None)]
    texts = [(i, " ".join(rng.choice(words) for _ in range(25)) + rng.choice(["", " " + alerts.NEGATIONS[0] + " "])) for i in range(30)] + [(30, facts[0][1]), (31, None), (32, "")]
    got = {(r.session, r.fact): r.kind for r in alerts.alerts(spark.createDataFrame(texts, "session long, text string"), spark.createDataFrame(facts, "fact long, stated string")).collect()}
    want = {}
    for s, t in texts:
        for f, stated in facts:
            w = [x for x in (stated or "").lower().split() if len(x) >= 3]
            if t and w:
                ratio = sum(x in t for x in w) / len(w)
                if ratio > 0.5 and stated not in t and any(n in t for n in alerts.NEGATIONS):
                    want[s, f] = "contradiction"
                elif ratio > 0.8:
                    want[s, f] = "reinforcement"
    assert got == want
    assert len(set(want.values())) == 2


def test_tokens_gather_by_session(spark, tmp_path):
    rows = [("a", i, "token", f"{i} ") for i in range(1500)] + [("a", 1500, "end", ""), ("a", 1501, "token", "again"), ("a", 1502, "flush", ""), ("b", 0, "token", "lost")]
    form = "session string, seq long, kind string, token string"
    spark.createDataFrame(rows[:900], form).coalesce(1).write.parquet(f"{tmp_path}/in")
    spark.createDataFrame(rows[900:], form).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = alerts.gathered(spark.readStream.schema(form).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("gathered").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.text for r in spark.table("gathered").collect()) == sorted(["".join(f"{i} " for i in range(1500)), "again"])


def propagate(edges, node, start, depth=5):
    value, queue, met = {node: start}, [(node, start, 0)], {node}
    for at, c, level in queue:
        if level == depth:
            continue
        for _, to, kind, w in sorted((t, b, k, w) for a, b, k, w, t in edges if a == at):
            cur = value.get(to, 1.0)
            if kind == "caused":
                cur = c * w * 0.9
            elif kind == "supersedes":
                cur = min(cur, c * 0.1)
            elif kind in ("supports", "contradicts"):
                cur += (c - 1) * w * 0.5 if kind == "supports" else -c * w * 0.7
                cur = min(1.0, max(0.0, cur))
            else:
                continue
            value[to] = cur
            if to not in met:
                met.add(to)
                queue.append((to, cur, level + 1))
    return value


def test_believed(spark):
    rng = random.Random(5)
    form = "source long, target long, edge_type string, weight double, created_at long"
    confidence = spark.createDataFrame([(i, 0.2 + i / 50) for i in range(30)] + [(None, 0.5)], "id long, confidence double")
    chain = [(i, i + 1, "caused", 1.0, 0) for i in range(9)]
    several = [(0, 1, "supports", 0.9, 1), (0, 1, "contradicts", 0.5, 2), (0, 1, "contradicts", 0.5, 2), (1, 0, "supersedes", 1.0, 3), (0, 2, "related", 1.0, 1)]
    dense = [(rng.randrange(25), rng.randrange(25), rng.choice(["caused", "supports", "contradicts", "supersedes", "before"]), rng.randint(1, 10) / 10, rng.randint(0, 5)) for _ in range(90)]
    for edges, node in ((chain, 0), (several, 0), (dense, 3), ([], 4)):
        got = {r.id: r.confidence for r in graph.believed(spark.createDataFrame(edges, form), confidence, node).collect()}
        want = propagate(edges, node, 0.2 + node / 50)
        assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())
    assert graph.believed(spark.createDataFrame(chain, form), confidence, 99).count() == 0


def test_write_actions(spark):
    near, far = [1.0, 0.0], [0.7, 0.714]
    rows = [
        (1, "fact", "my phone number is 1234", 1, near, "a"),
        (2, "fact", "my phone number is 4321", 2, near, "a"),  # the newer value
        (3, "fact", "same words", 1, near, "b"),
        (4, "fact", "same words", 2, near, "b"),  # a copy
        (5, "fact", "favourite city is now Rome", 1, near, "c"),
        (6, "fact", "favourite city is now Oslo", 1, near, "c"),  # of one instant: both stay
        (7, "correction", "the best coffee is black", 1, near, "d"),
        (8, "fact", "the best coffee is white", 2, near, "d"),  # loses against the earlier correction
        (9, "fact", "a walk", 1, far, "e"),
        (10, "fact", "one more thing", 2, near, "e"),  # similarity 0.7
        (11, "fact", "our team meets at noon", 1, near, "f"),
        (12, "fact", "lunch", 2, far, "f"),
        (13, "correction", "our team meets at ten", 3, near, "f"),  # updates 11, supersedes the nearest other
        (14, "fact", "same words", 5, near, "g"),
        (15, "fact", "same words", 5, near, "g"),  # a copy of the same instant
        (16, "fact", "see room 2 on friday", 1, near, "h"),
        (17, "fact", "see room 5 on friday", 2, near, "h"),  # two rooms, no update
        (18, None, None, None, near, "i"),
        (19, "fact", "nothing else here", 1, near, "i"),
    ]
    m = spark.createDataFrame(rows, "id long, memory_type string, content string, created_at long, embedding array<double>, user_id string").withColumn("agent_id", F.lit("x"))
    got = sorted((r.action, r.id, r.other) for r in lifecycle.write_actions(m).collect())
    assert got == [("deduplicate", 4, 3), ("invalidate", 2, 1), ("invalidate", 13, 11), ("invalidate_new", 8, 7), ("relate", 10, 9), ("relate", 12, 11), ("relate", 13, 12), ("supersede", 13, 12)]
    assert lifecycle.write_actions(m.limit(0)).count() == 0


def frame_update(a, b):
    x, y = (re.findall(r"[^\W_]+", t.lower()) for t in (a, b))
    least = min(len(x), len(y))
    pre = next((i for i in range(least) if x[i] != y[i]), least)
    suf = min(next((i for i in range(least) if x[-1 - i] != y[-1 - i]), least), least - pre)
    vx, vy = x[pre : len(x) - suf], y[pre : len(y) - suf]
    numbers = suf > 0 and all(w.isdigit() for w in vx + vy)
    return least >= 4 and pre >= 2 and 0 < max(len(vx), len(vy)) <= 4 and (pre + suf) / max(len(x), len(y)) >= 0.6 and not numbers


def test_write_actions_meet_in_blocks_without_texts(spark, monkeypatch):
    rng = random.Random(3)
    parts = ["My", "phone", "number", "is", "now", "red", "blue", "12", "7", "at", "home"]
    texts = [" ".join([*rng.choice([["My", "phone"], ["Our", "team"], ["my", "phone,"]]), *(rng.choice(parts) for _ in range(rng.randint(0, 7)))]) for _ in range(70)]
    texts += [texts[0], texts[0].upper(), "", "red"]
    rows = [(i, rng.choice(["fact", "correction"]), t, i // 2, [1.0, rng.random() * 1.5, rng.random() * 1.5]) for i, t in enumerate(texts)]
    m = spark.createDataFrame(rows, "id long, memory_type string, content string, created_at long, embedding array<double>").withColumns({"user_id": F.lit("u"), "agent_id": F.lit("x")})
    want = set()
    for a in rows:
        for b in rows:
            if (a[3], a[0]) < (b[3], b[0]) and cosine(a[4], b[4]) >= 0.3:
                tie, s = a[3] == b[3], round(cosine(a[4], b[4]), 9)
                if a[2] == b[2] and not tie and s > 0.85:
                    want.add(("deduplicate", b[0], a[0]))
                elif frame_update(a[2], b[2]):
                    if a[1] == "correction" != b[1]:
                        want.add(("invalidate_new", b[0], a[0]))
                    elif not tie or b[1] == "correction" != a[1]:
                        want.add(("invalidate", b[0], a[0]))
                elif 0.6 < s <= 0.85:
                    want.add(("relate", b[0], a[0]))
    kept = []
    monkeypatch.setattr(lifecycle, "written", lambda df, name: kept.append(df) or df)
    for block in (2000, 4):
        monkeypatch.setattr(lifecycle, "BLOCK", block)
        got = {(r.action, r.id, r.other) for r in lifecycle.write_actions(m, most=100).where("action <> 'supersede'").collect()}
        assert got == want and len({x for x, _, _ in got}) == 4
    assert {c for c, kind in kept[0].dtypes if kind == "string"} == {"ta", "tb"}  # memory types; no text goes with a pair


def test_nearest_rows_are_settled_where_a_block_meets_its_owner(spark, monkeypatch):
    monkeypatch.setattr(lifecycle, "BLOCK", 4)
    _, m = vectors(spark)
    near = lifecycle.nearest_pairs(m, 3, 0.4)
    assert "Window" not in near._jdf.queryExecution().optimizedPlan().toString()  # each block hands on 3 rows for a row, all blocks together
    assert max(r["count"] for r in near.groupBy("id").count().collect()) == 3


def test_cache_hits(spark, monkeypatch):
    rng = random.Random(4)
    words = ["The", "the", "red", "blue", "tea", "is", "hot", "cold", "and", "sweet"]
    texts = ["", " ", *{" ".join(rng.choice(words) for _ in range(rng.randint(1, 7))) for _ in range(120)}]
    cache = [(t, rng.choice([None, 1, 2, 3]), 0, 0) for t in texts[::2]]
    asks = [(rng.randrange(60), t) for t in texts] + [(60, "tea  hot"), (61, None), (62, "none of these")]
    parts = (spark.createDataFrame(asks, "ask long, query string"), spark.createDataFrame(cache, "topic string, created_at long, last_accessed long, hit_count long"))
    steps, kept = [], turns.written
    monkeypatch.setattr(turns, "written", lambda df, name: steps.append(name) or kept(df, name))
    for least in (0.5, 0.3, 1.0):
        want = {}
        for ask, query in asks:
            for topic, at, *_ in cache:
                a, b = (set((t or "").lower().split()) for t in (query, topic))
                if a | b and len(a & b) / len(a | b) > least:
                    want[ask] = min(want.get(ask, (0, 9, "")), (-len(a & b) / len(a | b), at or 0, topic))
        assert {r.ask: (-r.score, r.topic) for r in turns.cache_hits(*parts, least).collect()} == {k: (s, t) for k, (s, _, t) in want.items()}
    steps.clear()
    same = parts[1].select(F.lit(1).alias("ask"), F.concat("topic", F.lit(" "), "topic").alias("query"))
    assert turns.cache_hits(same, parts[1]).count() == 1 and steps == ["told"]  # no texts were compared
    assert turns.cache_hits(*(p.limit(0) for p in parts)).count() == 0


def steps_of(spark, monkeypatch, name):
    steps, kept = [], turns.written
    monkeypatch.setattr(turns, "written", lambda df, step: steps.append(step) or kept(df, step))
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count()
    return steps


def test_cache_stats_compare_no_texts_with_themselves(spark, monkeypatch):
    assert steps_of(spark, monkeypatch, "cache_stats") == ["told"]


def test_cache_after_hits_compares_no_texts_with_themselves(spark, monkeypatch):
    assert steps_of(spark, monkeypatch, "cache_after_hits") == ["told"]


def test_conflict_candidates(spark, monkeypatch):
    rows, m = vectors(spark)
    tag = {r[0]: [[], ["x", "scope:project:p"], ["scope:global"]][r[0] % 3] for r in rows}
    m = m.join(spark.createDataFrame(list(tag.items()), "id long, tags array<string>"), "id")
    edges = [(9, 3, "contradicts"), (6, 12, "supersedes"), (4, 7, "related"), (62, 63, "supersedes")]
    held = [r for r in rows if r[3] and r[1]]
    near = {(a[0], b[0]) for a in held for b in held if a[0] < b[0] and a[1] == b[1] and 0.1 <= cosine(a[3], b[3]) < 0.9 and tag[a[0]] == tag[b[0]]}
    want = near - {(min(s, t), max(s, t)) for s, t, kind in edges if kind != "related"}
    assert len(want) > 20
    for block in (2000, 2):
        monkeypatch.setattr(lifecycle, "BLOCK", block)
        got = upkeep.conflict_candidates(m, spark.createDataFrame(edges, "source long, target long, edge_type string"), 0.1, 0.9)
        assert {(r.a, r.b) for r in got.collect()} == want


def test_a_task_holds_one_block_and_a_stretch():
    own, passing = [], []

    def start(ids, x):
        def meet(others, y, same):
            if not same:
                passing.append(others.tolist())
            return ()

        own.append(ids.tolist())
        return meet, lambda: iter([(ids[:1],)])

    at, far = [0] * 9 + [1] * 5, [False] * 2 + [True] * 7 + [False] * 5
    table = pa.table({"at": at, "id": range(14), "embedding": [[1.0, 2.0]] * 14, "far": far})
    ends = [x[0].tolist() for x in lifecycle._passed(table.to_batches(max_chunksize=6), ["at"], start, 3)]
    assert own == [[0, 1], [9, 10, 11, 12, 13]] and passing == [[2, 3, 4], [5], [6, 7, 8]] and ends == [[0], [9]]


def test_compressed_trims_spaces_and_no_digits(spark):
    rows = [(1, "007 agents. 1 must go. must stay 1"), (2, " . First. Second"), (3, "a.  must b \n\n  . c0. d"), (4, ""), (5, " . "), (6, None)]
    got = {r.id: r.content for r in lifecycle.compressed(spark.createDataFrame(rows, "id long, content string")).collect()}
    assert got == {1: "007 agents. 1 must go. must stay 1", 2: "First", 3: "a. must b. c0", 4: "", 5: "", 6: None}


def test_rendezvous(spark):
    def weight(key, node):
        h = text.FNV_BASIS
        for byte in node.encode() + b"\x1f" + key.encode():
            h = (h ^ byte) * text.FNV_PRIME % 2**64
        return h

    keys, nodes = ["", "a", "user-17", "é 漢字", "x" * 300, None, "a"], ["n1", "n2", "node é", "n10"]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    got = sorted((r.key or "", r.node or "") for r in upkeep.rendezvous(df, nodes).collect())
    assert got == sorted((k or "", max((weight(k, n), n) for n in nodes)[1] if k is not None else "") for k in keys)
    assert {r.node for r in upkeep.rendezvous(df, []).collect()} == {None}
    assert upkeep.rendezvous(df.limit(0), nodes).count() == 0


def test_consolidated(spark):
    rows = [
        (1, "Tea is green. It is hot!  Tea is green", 0.5, [3.0, 0.0], 1),
        (2, " it is hot! tea is green\n. New", 0.9, [0.0, 4.0], 1),
        (3, "Other length.", 0.1, [1.0], 1),
        (4, None, 0.2, [0.0, 0.0], 4),
        (5, " . ", 0.3, [0.0, 0.0], 4),
        (6, "alone", 0.4, None, 6),
    ]
    m = spark.createDataFrame([r[:4] for r in rows], "id long, content string, confidence double, embedding array<double>")
    label = spark.createDataFrame([(r[0], r[4]) for r in rows], "id long, component long")
    want = {}
    for c in {r[4] for r in rows}:
        group = [r for r in rows if r[4] == c]
        said = list(dict.fromkeys(x.strip().lower() for r in group for x in (r[1] or "").split(".") if x.strip()))
        vectors = np.array([r[3] for r in group if r[3] and group[0][3] and len(r[3]) == len(group[0][3])])
        mean = vectors.mean(axis=0) if len(vectors) else None
        unit = None if mean is None else (mean / np.linalg.norm(mean) if mean.any() else mean).round(9).tolist()
        want[c] = (". ".join(said), max(r[2] for r in group), unit)
    got = {r.component: (r.content, r.confidence, r.embedding and [round(v, 9) for v in r.embedding]) for r in lifecycle.consolidated(m, label).collect()}
    assert got == want
    assert lifecycle.consolidated(m.limit(0), label).count() == 0
