"""The operators against brute force, on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from anamnesis.llm import ann, decontamination, feistel, language, mixing, ngram_join, quality, queries, token_counts, token_output, toxicity, url_filter
from anamnesis.llm.components import components

DOC = "doc_id long, text string, lang string, source string, n_chars long, id string, t string, n int, row int, copy int, size int, w int"


def table(spark, texts, **more):
    rows = [(i, t, (more.get("lang") or ["en"])[i % len(more.get("lang") or ["en"])], (more.get("source") or ["s"])[i % len(more.get("source") or ["s"])], len(t or ""), "x", "y", 1, 2, 3, 4, 5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def prose(rng, n, words="alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()):
    return " ".join(rng.choice(words) + str(rng.randint(0, 30)) for _ in range(n))


TEXTS = [None, "", "  \n\t", "one", "a b c d", "Same text here for all of it", "Same text here for all of it", "x" * 5000, "é ß 漢字 𝒳 don't <|endoftext|> we'll  two\r\n\n spaces "]


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 7, 100, 1023):
        x = np.arange(n)
        y = feistel.permute(x, n, 42)
        assert sorted(y.tolist()) == list(range(n))
        assert (feistel.invert(y, n, 42) == x).all()


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://com/en/", "http://a.COM/en/x?q#f", "https://example.com/en/75", "http://x.example.com/en/8", "http://net/de", "http://y.net/de/1", "http://example.net/de/80", "http://evilcom/en/", "http://b.org?x=/es/", "http://b.org/es/", "http://z.io/x.com/en/"]
    rows = url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), queries.URL_RULES).collect()
    rules = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
    for r in rows:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", urls[r.page_id] or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [x for x in rules if (host == x[0] or host.endswith("." + x[0])) and path.startswith(x[1])]
        best = max(fits, key=lambda x: len(x[0] + x[1]), default=None)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best[0] + best[1] if best else None, best[2] if best else "allow")


def test_globs_over_several_words():
    rng = random.Random(3)
    globs = ["*".join("".join(rng.choice("ab/") for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(1, 4))) for _ in range(60)]
    texts = ["".join(rng.choice("ab/") for _ in range(rng.randint(0, 12))).encode() for _ in range(200)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    got = url_filter.Automaton(globs).matches(data, np.cumsum([0] + [len(t) for t in texts]))
    for g, glob in enumerate(globs):
        pattern = re.compile("".join(".*" if p == "**" else "[^/]*" if p == "*" else re.escape(p) for p in re.findall(r"\*\*|\*|[^*]+", glob)), re.S)
        assert [bool(pattern.fullmatch(t.decode())) for t in texts] == got[:, g].tolist()


def test_token_counts(spark):
    from tokenizers import Tokenizer

    rng = random.Random(1)
    parts = ["a", "the", " ", "  ", "\n", "\t", "'", "'s", "'ll", "1", "23", "é", "!", "..", "<|endoftext|>", " '", "漢", "\x1c", "\x85", "²"]
    texts = TEXTS + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    tok = Tokenizer.from_file(queries.tokenizer_path())
    got = {r.doc_id: r for r in token_counts.count_tokens(table(spark, texts), queries.tokenizer_path()).collect()}
    for i, t in enumerate(texts):
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 1024), t
    assert token_counts.count_tokens(table(spark, []), queries.tokenizer_path()).count() == 0


def shingles(t):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def linked(texts):
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= 75 * (len(sets[a]) + len(sets[b]) - i):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def near_copies(rng):
    texts = list(TEXTS)
    for _ in range(12):
        base = prose(rng, rng.randint(6, 90)).split()
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = "changed" + str(rng.randint(0, 99))
            texts.append(" ".join(copy))
    return texts


def test_ngram_join(spark, monkeypatch):
    texts = near_copies(random.Random(7))
    n, component = linked(texts)
    for hot in (ngram_join.HOT, 1):  # with lists split into blocks too
        monkeypatch.setattr(ngram_join, "HOT", hot)
        got = {r.doc_id: r for r in ngram_join.near_duplicates(table(spark, texts)).collect()}
        assert [got[i].n_shingles for i in range(len(texts))] == n
        assert [got[i].component_id for i in range(len(texts))] == component
    assert ngram_join.near_duplicates(table(spark, [])).count() == 0


def test_ngram_join_of_a_shingle_that_very_many_texts_share(spark, monkeypatch):
    """Long lists with pivots and blocks, and families split into blocks; half of the texts are close but no links."""
    rng = random.Random(17)
    head = "one two three four five six"
    base = [f"w{i}" for i in range(30)]
    texts = []
    for i in range(700):
        tail = list(base)
        for _ in range(rng.choice([1, 2, 4, 5])):
            tail[rng.randrange(30)] = f"x{rng.randint(0, 400)}"
        texts.append(" ".join([head] + tail) if i % 2 else head + " " + " ".join(f"y{rng.randint(0, 90)}" for _ in range(3)))
    n, component = linked(texts)
    monkeypatch.setattr(ngram_join, "LONG", 60)
    monkeypatch.setattr(ngram_join, "SHORT", 5)
    monkeypatch.setattr(ngram_join, "FAMILY", 2000)
    got = {r.doc_id: r for r in ngram_join.near_duplicates(table(spark, texts)).collect()}
    assert [got[i].component_id for i in range(len(texts))] == component
    assert 1 < len(set(component)) < len(texts)


def test_ngram_join_of_names_that_clash():
    h = np.arange(10, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    c, d = ngram_join.names_of(h, np.array([0, 3, 7, 7, 10]))
    same = np.full(4, c[0])
    assert len(set(ngram_join.keys_of(same, d, c[:1]).tolist())) == 4
    assert (ngram_join.keys_of(c, d, np.zeros(0, np.uint64)) == c).all()


def test_parity_sketches_bound_the_difference():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (3, 200, 250, 260, 900, 1100)]
    sets += [np.sort(np.concatenate([s[: len(s) * 9 // 10], rng.integers(0, 1 << 63, len(s) // 10).astype(np.uint64)])) for s in sets]
    parts = [ngram_join.parities_of(s, np.array([0, len(s)]))[0] for s in sets]
    sketches = ngram_join.Sketches(parts, 75)
    for a in range(6):
        apart = int(sketches.apart(np.array([a]), np.array([a + 6]))[0])
        assert apart <= len(np.setxor1d(sets[a], sets[a + 6])) and (apart > 0 or len(sets[a]) < 10)
    assert int(sketches.apart(np.array([2]), np.array([3]))[0]) > 150  # of different lengths, folded


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (102, 102), (103, 100)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


@pytest.mark.parametrize("memory", [40_000, 0])
def test_decontamination(spark, monkeypatch, memory):
    monkeypatch.setattr(decontamination, "MEMORY_ROWS", memory)
    rng = random.Random(5)
    items = [prose(rng, 30), "two Words", "one", None, "", "!!", prose(rng, 13), "a b a b a b a b a b a b a b a b"]
    texts = TEXTS + [prose(rng, 20) + ", " + items[0] + " " + prose(rng, 3), items[6].upper(), "x two--words, one", "a b " * 12, prose(rng, 40)]
    got = {r.doc_id: r for r in decontamination.find(table(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    for i, t in enumerate(texts):
        w, hit, who = words(t), set(), set()
        for k, item in enumerate(items):
            v = words(item)
            size = min(13, len(v))
            windows = {tuple(v[a : a + size]) for a in range(len(v) - size + 1)} if v else set()
            for a in range(len(w) - size + 1 if v else 0):
                if tuple(w[a : a + size]) in windows:
                    hit.update(range(a, a + size))
                    who.add(str(k))
        sha = hashlib.sha256(",".join(sorted(who)).encode()).hexdigest()
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256, got[i].contaminated) == (len(w), len(hit), len(who), sha, bool(hit) and 20 * len(hit) >= len(w)), t


def test_ann_recall(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((4000, 16)).astype(np.float32)
    x[100:1500] = x[7]  # a third of all rows are one vector
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(5000, None), (5020, []), (5040, [0.0] * 16), (5060, [float("nan")] * 16), (5080, [None] + [1.0] * 15), (5100, [1.0] * 3)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), ann.F.col("vec_id") % 50 == 0, k=20).toPandas()
    assert sorted(got.query_id.unique()) == list(range(0, 4000, 50))
    s = x.astype(float) @ x.astype(float).T
    found = 0
    for q, part in got.groupby("query_id"):
        part = part.sort_values("rank")
        assert part["rank"].tolist() == list(range(1, 21)) and q not in part.vec_id.tolist()
        assert np.allclose(part.score, s[q, part.vec_id])
        order = [i for i in np.lexsort((np.arange(4000), -s[q])) if i != q][:20]
        found += len(set(order) & set(part.vec_id))
    assert found >= 0.9 * 20 * 80
    few = ann.search(spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>"), ann.F.lit(True), k=20)
    assert few.count() == 6


def test_ann_recall_where_parts_outgrow_the_sample(spark, monkeypatch):
    monkeypatch.setattr(ann, "SPREAD", 0.366)  # 40 parts
    monkeypatch.setattr(ann, "SAMPLE", 600)
    monkeypatch.setattr(ann, "PER_PART", 15)  # a floor of 400 rows probes 27 of these parts, but 2 of the index
    monkeypatch.setattr(ann, "QUERY_ROWS", 50)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 200)
    x = np.random.default_rng(3).standard_normal((12_000, 4))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), ann.F.col("vec_id") % 50 == 0, k=100).toPandas()
    s = x[::50] @ x.T
    s[np.arange(240), np.arange(0, 12_000, 50)] = -np.inf
    exact = {(50 * i, j) for i, row in enumerate(s) for j in np.argsort(-row)[:100].tolist()}
    assert len(exact & set(zip(got.query_id, got.vec_id))) >= 0.97 * len(exact)


def test_ann_recall_over_many_parts(spark, monkeypatch):
    monkeypatch.setattr(ann, "SPREAD", 0.7747)
    fit, parts = ann.fit, []
    monkeypatch.setattr(ann, "fit", lambda *a: parts.append(len((router := fit(*a)).b2)) or router)
    x = np.random.default_rng(4).standard_normal((6000, 16))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), ann.F.col("vec_id") % 50 == 0, k=20).toPandas()
    assert parts == [60]
    s = x[::50] @ x.T
    s[np.arange(120), np.arange(0, 6000, 50)] = -np.inf
    exact = {(50 * i, j) for i, row in enumerate(s) for j in np.argsort(-row)[:20].tolist()}
    assert len(exact & set(zip(got.query_id, got.vec_id))) >= 0.9 * len(exact)


def test_ann_ties_across_the_last_place(spark):
    rows = [(i, [1.0, float(i % 3)]) for i in range(300)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), ann.F.col("vec_id") < 5, k=20).collect()
    for q in range(5):
        want = sorted((i for i in range(300) if i != q), key=lambda i: (-(1 + (q % 3) * (i % 3)), i))[:20]
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want


def test_texts_that_are_not_utf8(spark):
    bad = spark.sql("SELECT 1L AS doc_id, CAST(X'6162FF6364' AS STRING) AS text UNION ALL SELECT 2L, CAST(X'C3' AS STRING) UNION ALL SELECT 3L, 'plain'")
    good = table(spark, ["ab\ufffdcd", "\ufffd", "plain"])
    for run in (lambda d: token_counts.count_tokens(d, queries.tokenizer_path()).select("n_bytes", "n_tokens"), lambda d: language.predict(d, language.fit(good, ann.F.lit(True))).select("lang_pred"), lambda d: ngram_join.near_duplicates(d).select("n_shingles")):
        assert sorted(map(str, run(bad).collect())) == sorted(map(str, run(good).collect()))


def test_long_texts_are_taken_by_pieces(monkeypatch):
    from anamnesis.llm import common

    text = np.frombuffer(prose(random.Random(3), 3000).encode(), np.uint8)
    ends = np.array([0, len(text)])
    whole, features = common.word_hashes(text, ends)[0], quality.passages(text, ends)
    monkeypatch.setattr(common, "PIECE_BYTES", 1000)
    monkeypatch.setattr(quality, "PIECE", 2000)
    assert (common.word_hashes(text, ends)[0] == whole).all()
    pieces = quality.passages(text, ends)
    assert np.allclose(pieces[0], features[0]) and (pieces[1] == features[1]).all() and len(features[0]) == 47


def test_attention_weighs_passages():
    """The forward pass against a plain loop."""
    rng = np.random.default_rng(5)
    x, owner = rng.standard_normal((7, quality.FEATURES)), np.array([0, 0, 0, 1, 2, 2, 2])
    p = [rng.standard_normal(s) / 4 for s in ((quality.FEATURES, quality.ENCODED), quality.ENCODED, (quality.ENCODED, quality.GATES), (quality.ENCODED, quality.GATES), quality.GATES, quality.ENCODED, 1)]
    y = quality.Model(np.zeros(quality.FEATURES), np.ones(quality.FEATURES), p).forward(x, owner, 3)[-1]
    for bag in range(3):
        h = [np.tanh(r @ p[0] + p[1]) for r in x[owner == bag]]
        e = np.array([(np.tanh(v @ p[2]) / (1 + np.exp(-(v @ p[3])))) @ p[4] for v in h])
        a = np.exp(e) / np.exp(e).sum()
        z = sum(w * v for w, v in zip(a, h))
        assert np.isclose(y[bag], 1 / (1 + np.exp(-(z @ p[5] + p[6][0]))))


def test_folded_weights_are_the_landmark_kernel():
    """A word's score by folded weights equals the machine's value through kernel values with the landmarks."""
    landmarks, strings = ["idiot", "stupid", "table"], ["idiot", "idxiot", "stable", "chair", "stu"]
    k, known, z = toxicity.nystroem(landmarks, strings)
    w = np.array([0.7, -0.2, 0.4])
    folded = np.zeros(toxicity.SYMBOLS**3, np.float32)
    folded[known] = w @ z
    assert np.allclose(toxicity.Machine(folded, 0.0).score("\n".join(strings)), k @ w, atol=1e-4)


def test_mixing(spark):
    rng = random.Random(4)
    texts = TEXTS + [prose(rng, rng.randint(0, 400)) for _ in range(60)]
    docs = table(spark, texts, source=["a", "b", None, "d"])
    docs = docs.union(docs.limit(3))  # repeated rows
    got = mixing.mix_counts(mixing.mix(docs, block=16)).toPandas()
    again = mixing.mix_counts(mixing.mix(docs, block=16)).toPandas()
    assert sorted(map(str, got.values.tolist())) == sorted(map(str, again.values.tolist()))
    assert len(got) == docs.count() and (got.taken <= 2 * got["size"]).all()
    per = got.groupby(["source_size", "target"]).agg(taken=("taken", "sum")).reset_index()
    assert (abs(per.taken - per.target) <= 1).all()
    m = mixing.mix(docs, block=16)
    out = mixing.mixed_documents(docs, m)
    assert out.columns == docs.columns
    total = out.select(mixing.F.sum(mixing.F.regexp_count("text", mixing.F.lit(mixing.WORD)))).collect()[0][0]
    assert total == got.taken.sum()
    assert mixing.mix_counts(mixing.mix(table(spark, []))).count() == 0


def test_share_targets():
    assert mixing.share_targets([100, 100], [3, 1], 300, 2.0) == [200.0, 100.0]
    assert mixing.share_targets([10, 1000, 1000], [3, 1, 2], 3015, 2.0) == pytest.approx([20, 998.33333, 1996.66667])
    assert mixing.share_targets([0, 5], [3, 1], 7.5, 2.0) == [0.0, 7.5]


def test_token_output_round_trip(spark):
    texts = TEXTS + [prose(random.Random(i), 30 + i) for i in range(40)]
    path = queries.tokenizer_path("byte_bpe_50k.tiktoken")
    index = token_output.materialise(table(spark, texts).repartition(3), path, length=64)
    n = index.count()
    assert sorted(r.slot for r in index.select("slot").collect()) == list(range(n))
    seqs = list(token_output.read_sequences(spark, index, 0, n, length=64))
    code = token_output.encoder(path)
    want = Counter()
    for t in texts:
        want.update(code.encode_ordinary(t or "") + [token_output.END])
    assert Counter(int(x) for s in seqs for x in s) == want
    part = list(token_output.read_sequences(spark, index, 3, 6, length=64))
    assert all((a == b).all() for a, b in zip(part, seqs[3:6], strict=True))
    assert {i for r in index.collect() for i in r.doc_ids} == set(range(len(texts)))
    assert token_output.materialise(table(spark, []), path).count() == 0


def test_language(spark):
    rng = random.Random(6)
    en, fr = "the of and thing with house".split(), "le une des maison avec été".split()
    texts = [" ".join(rng.choice(en if i % 2 == 0 else fr) for _ in range(12)) for i in range(80)]
    docs = table(spark, texts, lang=["en", "fr"])
    model = language.fit(docs, ann.F.col("doc_id") % 4 != 0)
    got = {r.doc_id: r for r in language.predict(table(spark, texts + [None, "", "12 !!"]), model).collect()}
    assert [got[i].lang_pred for i in range(80)] == ["en", "fr"] * 40
    assert [got[i].lang_pred for i in (80, 81, 82)] == ["und"] * 3
    assert all(0 <= r.score <= 1 for r in got.values())
    blank = language.fit(table(spark, []), ann.F.lit(True))
    assert language.predict(docs, blank).select("lang_pred").distinct().collect()[0][0] == "und"


def test_language_masks_hold_their_grams():
    rng = np.random.default_rng(7)
    members = [rng.integers(0, 1 << 62, n).astype(np.uint64) for n in (3000, 10, 0)] + [np.zeros(0, np.uint64)] * 70
    members[72] = members[0][:500]
    f = language.build([str(i) for i in range(73)], members)
    got = f.lookup(members[0])
    assert ((got[:, 0] & np.uint64(1)) == 1).all() and ((got[:500, 1] >> np.uint64(8)) & np.uint64(1) == 1).all()
    assert (f.lookup(rng.integers(0, 1 << 62, 4000).astype(np.uint64))[:, 0] & np.uint64(1)).mean() < 0.02


def test_language_of_grams_seen_once(spark):
    docs = table(spark, ["the house and the thing with the house and the thing", "zwölf große boxkämpfer"], lang=["en", "sv"])
    model = language.fit(docs, ann.F.lit(True))
    got = {r.doc_id: r.lang_pred for r in language.predict(table(spark, ["the house", "boxkämpfer"]), model).collect()}
    assert got == {0: "en", 1: "sv"}


def test_toxicity_tolerates_gaps(spark):
    rng = random.Random(8)
    bad = "worthless idiot pathetic disgusting".split()
    texts, marks = [], []
    for i in range(300):
        w = prose(rng, 40).split()
        if i % 5 == 0:
            for _ in range(3):
                w[rng.randrange(40)] = rng.choice(bad)
        texts.append(" ".join(w))
        marks.append((i, int(i % 5 == 0)))
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    machine = toxicity.fit(table(spark, texts), labels, ann.F.col("doc_id") % 4 != 0)
    plain = prose(rng, 30)
    probes = [plain + " i.d.i.o.t worth-less", plain + " idxiot w o r t h l e s s", plain, None, ""]
    got = {r.doc_id: r for r in toxicity.score(table(spark, texts + probes), machine).collect()}
    assert np.mean([got[i].predicted == y for i, y in marks]) > 0.97
    assert [got[300 + k].predicted for k in range(5)] == [1, 1, 0, 0, 0]
    kept = toxicity.keep_clean(table(spark, texts), machine)
    assert kept.columns == table(spark, []).columns and {r.doc_id for r in kept.collect()} == {i for i in range(300) if got[i].predicted == 0}


def test_pieces_are_the_parts_that_are_scored():
    letters = "".join(chr(97 + i % 26) for i in range(100))
    for n in (1, 3, 23, 24, 25, 36, 37, 60, 100):
        whole, parts = toxicity.matrix([letters[:n]]), toxicity.matrix(toxicity.pieces(letters[:n]))
        assert np.array_equal(whole[0], parts[0]) and np.array_equal(whole[1], parts[1])
        assert parts[2].tolist() == list(range(len(parts[0])))
    with pytest.raises(ValueError):
        toxicity.describe([letters])


def test_toxicity_is_learned_from_all_of_a_long_word(spark):
    """Insults that stand only behind the first 24 letters of unspaced strings, which recur."""
    rng = random.Random(28)
    heads = ["".join(prose(rng, 8).split())[:40] for _ in range(3)]
    texts, marks = [], []
    for i in range(300):
        w = prose(rng, 30).split()
        w[rng.randrange(30)] = rng.choice(heads) + rng.choice(["worthless", "pathetic"] if i % 4 == 0 else ["wonderful", "sympathy"])
        texts.append(" ".join(w))
        marks.append((i, int(i % 4 == 0)))
    machine = toxicity.fit(table(spark, texts), spark.createDataFrame(marks, "doc_id long, toxic int"), ann.F.col("doc_id") >= 0)
    got = {r.doc_id: r.predicted for r in toxicity.score(table(spark, texts), machine).collect()}
    assert np.mean([got[i] == y for i, y in marks]) > 0.95


def test_quality(spark):
    rng = random.Random(9)
    texts = [prose(rng, 150) if i % 3 else " ".join(x.upper() + "!!" for x in prose(rng, 20).split()) for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(240)], "doc_id long, quality int")
    model = quality.fit(table(spark, texts), labels, ann.F.col("doc_id") % 4 != 2)
    got = {r.doc_id: r for r in quality.score(table(spark, texts + [None, "", "one"]), model).collect()}
    assert np.mean([got[i].predicted == int(i % 3 > 0) for i in range(240) if i % 4 == 2]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values()) and len(got) == 243
