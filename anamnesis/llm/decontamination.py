"""Benchmark decontamination by a prefix-filtered set join; DataFrame operations only.

An item's windows are runs of `window` words (the whole item, if shorter). A window's shingles are its runs of up to
three words; it occurs in a document only if all of them do, side by side. So one necessary prefix token for each
window suffices, and the rarest over the whole corpus is taken. One pass over the documents keeps the places of the
benchmark's shingles; their counts give the rarity; prefix tokens join windows to places; length and positional bounds
follow; and the words themselves are compared over the window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

SHINGLE = 3
#: The benchmark's distinct shingles go into the scan as a hash set, and its windows to every executor, up to so many; beyond, both are joined.
MEMORY_ROWS = 40_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """A-Z lower-cased; the runs of letters, digits and characters beyond ASCII. Null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), "")


def _gram(words: str, i: str, n: int) -> str:
    return f"concat_ws(' ', {', '.join(f'{words}[{i} + {k}]' for k in range(n))})"


def _hash(words: str, i: str, n: int) -> str:
    return f"xxhash64({', '.join(f'{words}[{i} + {k}]' for k in range(n))})"


def benchmark_windows(items: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """Distinct windows: size, n (words of a shingle), grams, items (ids as strings)."""
    words = items.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w")).where("size(w) > 0")
    spans = words.withColumn("size", F.least(F.size("w"), F.lit(window))).withColumn("at", F.explode(F.expr("sequence(0, size(w) - size)")))
    cut = spans.select("item", "size", F.expr("slice(w, at + 1, size)").alias("w")).withColumn("n", F.least("size", F.lit(SHINGLE)))
    grams = F.expr("transform(sequence(0, size - n), k -> concat_ws(' ', slice(w, k + 1, n)))")
    hashes = F.expr(f"transform(sequence(0, size - n), k -> CASE n {' '.join(f'WHEN {n} THEN {_hash("w", "k", n)}' for n in range(1, SHINGLE + 1))} END)")
    return cut.withColumns({"grams": grams, "hashes": hashes}).groupBy("size", "n", "grams", "hashes").agg(F.collect_set("item").alias("items"))


def places(windows: DataFrame, n: int, in_memory: bool) -> Column:
    """Places of the benchmark's n-word shingles in the column `w`, ascending: array of struct of i, g."""
    found = windows.where(F.col("n") == n).select(F.explode("hashes").alias("h")).distinct()
    listed = ",".join(f"{r[0]}L" for r in found.collect()) if in_memory else ""
    every = f"sequence(0, size(w) - {n})"
    test = f"{_hash('w', 'i', n)} IN ({listed})" if listed else "true"
    return F.expr(f"CASE WHEN size(w) >= {n} THEN transform(filter({every}, i -> {test}), i -> struct(i AS i, {_gram('w', 'i', n)} AS g)) ELSE array() END")


def find(docs: DataFrame, items: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", per_hit: int = 20) -> DataFrame:
    """What of a benchmark occurs in each document.

    Returns a row for each row of docs: id, n_words, n_hit (words inside an occurrence of a window), n_items,
    items_sha256 (of the item ids, sorted as strings, comma-joined; of the empty string without any), contaminated
    (n_hit > 0 and per_hit * n_hit >= n_words), and `row`, a number that tells repeated ids apart. Null and empty texts
    have no words; items without words have no windows; an item id of null is left out of the list but its words hit.
    """
    spark: SparkSession = docs.sparkSession
    windows = written(benchmark_windows(items, window, item_col, item_text).withColumn("id", F.monotonically_increasing_id()), "windows")
    sizes = {r[0]: (r[1], r[2]) for r in windows.select("n", "id", F.explode("hashes").alias("h")).groupBy("n").agg(F.countDistinct("h"), F.countDistinct("id")).collect()}
    in_memory = all(max(r) <= MEMORY_ROWS for r in sizes.values())
    split = docs.select(F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("w"))
    found = {f"m{n}": places(windows, n, in_memory) for n in sorted(sizes)}
    scanned = written(split.select(F.monotonically_increasing_id().alias("row"), "id", F.size("w").alias("n_words"), *[c.alias(k) for k, c in found.items()]), "places")
    base = scanned.select("row", "id", "n_words")
    hits = None
    for n in sorted(sizes):
        mine = windows.where(F.col("n") == n)
        at = scanned.select("row", "n_words", F.posexplode(f"m{n}").alias("a", "m"), f"m{n}")
        reach = max(window - n, 0)
        run = F.expr(f"slice(m{n}, greatest(a - {reach}, 0) + 1, {2 * reach + 1})")
        at = at.select("row", "n_words", F.col("m.i").alias("i"), F.col("m.g").alias("g"), F.least("a", F.lit(reach)).alias("a"), run.alias("run"))
        # rarity over all documents; a window with a shingle that no document has cannot occur
        counts = scanned.select(F.explode(f"m{n}.g").alias("g")).groupBy("g").agg(F.count("*").alias("c"))
        ranked = mine.select("id", F.posexplode("grams").alias("o", "g")).join(counts, "g", "left").select("id", F.struct(F.coalesce("c", F.lit(0)).alias("c"), "g", "o").alias("p"))
        prefix = ranked.groupBy("id").agg(F.min("p").alias("p")).where("p.c > 0")
        tokens = prefix.join(mine, "id").select("grams", "items", F.col("size").alias("length"), F.col("p.g").alias("g"), F.col("p.o").alias("o"))
        tokens = written(tokens, "prefixes")
        if in_memory:
            tokens = F.broadcast(tokens)
        near = at.join(tokens, "g")
        # positional and length bounds, then the words
        count = F.size("grams")
        near = near.withColumn("s", F.col("a") - F.col("o")).where((F.col("i") >= F.col("o")) & (F.col("i") - F.col("o") + F.col("length") <= F.col("n_words")) & (F.col("s") >= 0) & (F.col("s") + count <= F.size("run")))
        near = near.where(F.expr("get(run, s).i = i - o AND get(run, s + size(grams) - 1).i = i - o + size(grams) - 1"))
        exact = near.where(F.expr("slice(run, greatest(s, 0) + 1, size(grams)).g = grams"))
        part = exact.select("row", (F.col("i") - F.col("o")).alias("begin"), F.expr("i - o + length").alias("end"), "items")
        hits = part if hits is None else hits.unionByName(part)
    if hits is None:
        hits = spark.createDataFrame([], "row long, begin int, end int, items array<string>")
    covered = F.expr("aggregate(array_sort(spans), named_struct('n', 0L, 'to', 0), (x, s) -> named_struct('n', x.n + greatest(0, s.end - greatest(x.to, s.begin)), 'to', greatest(x.to, s.end)), x -> x.n)")
    sums = hits.groupBy("row").agg(F.collect_set(F.struct("begin", "end")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("names"))
    rows = base.join(sums.select("row", covered.alias("n_hit"), "names"), "row", "left")
    names = F.coalesce("names", F.array().cast("array<string>"))
    rows = rows.select("row", F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"))
    return rows.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * per_hit >= F.col("n_words")))
