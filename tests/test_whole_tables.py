"""Queries without SQL take part with all rows of their tables."""

from anamnesis.operators import analytics
from anamnesis.queries import QUERIES, mem
from anamnesis.sources import tables as T

DATA = "/root/testdata/sf0.001"


def test_context_window_ranks_all_memories(spark):
    left, kept = 4096, []
    for r in sorted(mem(spark, DATA).select("id", "salience", "content").collect(), key=lambda r: (-r.salience, r.id))[:40]:
        cost = -(-len(r.content.split()) * 13 // 10)
        if cost <= left:
            left -= cost
            kept.append((r.id, len(kept), cost))
    assert any(i % 9 for i, _, _ in kept)
    assert sorted(tuple(r) for r in QUERIES["context_window"](spark, DATA).select("id", "place", "cost").collect()) == sorted(kept)


def test_entity_resolution_has_an_alias_for_every_name(spark, tmp_path):
    spark.createDataFrame([(f"Part {i:03}",) for i in range(80)] + [("PART 007",)], "p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.name: (r.canonical, r.confidence) for r in QUERIES["entity_resolution"](spark, str(tmp_path)).collect()}
    assert got == {f"Part {i:03}": (f"Part {i:03}" if i != 7 else "PART 007", 1.0) for i in range(80)} | {"PART 007": ("PART 007", 1.0)}
    assert QUERIES["entity_resolution"](spark, DATA).count() == T.table(spark, DATA, "part").select("p_name").distinct().count()


def test_names_without_alias_resolve_by_words_or_to_themselves(spark):
    names = spark.createDataFrame([("ring",), ("small ring",), ("Bolt",)], "name string")
    aliases = spark.createDataFrame([("small ring", "small ring", 1.0)], "alias string, canonical string, confidence double")
    got = {tuple(r) for r in analytics.resolved_names(names, aliases).collect()}
    assert got == {("ring", "small ring", 0.7), ("small ring", "small ring", 1.0), ("Bolt", "bolt", 1.0)}
