"""Token streams on Structured Streaming (W1-W3): text gathers by session and is checked against known facts."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..fixed import NEGATIONS
from ..functions.text import contains_any

RING = 1000
#: Words of one automaton, at most.
VOCABULARY = 200_000


def alerts(texts: DataFrame, facts: DataFrame, conflict: float = 0.5, confirm: float = 0.8) -> DataFrame:
    """texts: session, text. facts: fact, stated. Of each fact's words of three bytes or more, the share found in the text:
    above `conflict` and not verbatim, with a negation: contradiction; else above `confirm`: reinforcement. session, fact,
    kind.

    Each distinct word is looked for once in a text, by an automaton of all of them that reads the text once; the words
    found join the facts, and only facts with enough words meet the text again. The facts' distinct words, VOCABULARY at
    most for each automaton, are shared; more words become several automata.
    """
    split = facts.select("fact", F.lower("stated").alias("stated"), F.filter(F.split(F.lower("stated"), r"\s+"), lambda w: F.octet_length(w) >= 3).alias("words")).where(F.size("words") > 0)
    held = split.select("fact", F.size("words").alias("n"), F.explode("words").alias("word")).groupBy("fact", "n", "word").agg(F.count("*").alias("times"))
    listed = [r[0] for r in held.select("word").distinct().orderBy("word").toLocalIterator()]
    texts = texts.select("session", F.lower("text").alias("low"))
    found = None
    for lo in range(0, len(listed), VOCABULARY):
        part = texts.mapInArrow(_finder(listed[lo : lo + VOCABULARY]), _found_schema(texts))
        found = part if found is None else found.union(part)
    if found is None:
        return texts.limit(0).select("session", F.lit(0).alias("fact"), F.lit("").alias("kind"))
    counts = found.join(held, "word").groupBy("session", "fact", "n").agg(F.sum("times").alias("got")).withColumn("ratio", F.col("got") / F.col("n"))
    near = counts.where((F.col("ratio") > conflict) | (F.col("ratio") > confirm))
    both = near.join(split.select("fact", "stated"), "fact").join(texts, "session")
    differs = (F.col("ratio") > conflict) & ~F.contains("low", F.col("stated"))
    kind = F.when(differs & contains_any(F.col("low"), NEGATIONS), "contradiction").when(F.col("ratio") > confirm, "reinforcement")
    return both.select("session", "fact", kind.alias("kind")).where("kind IS NOT NULL")


def _found_schema(texts: DataFrame) -> str:
    return f"session {texts.schema['session'].dataType.simpleString()}, word string"


def _finder(words: list[str]):
    """Which of the words are somewhere in each text: session, word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for i, w in enumerate(words):
            machine.add_word(w, i)
        machine.make_automaton()
        for batch in batches:
            rows, hits = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                got = {w for _, w in machine.iter(t or "")}
                rows += [i] * len(got)
                hits += [words[w] for w in got]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(hits, pa.string())], names=["session", "word"])

    return run


class Gather(StatefulProcessor):
    """Gathers the tokens of a session, the last RING apart from what came before; end and flush emit the text and clear it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.before = handle.getValueState("before", "text string")
        self.ring = handle.getListState("ring", "token string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        before = self.before.get()[0] if self.before.exists() else ""
        held = [r[0] for r in self.ring.get()]
        for part in rows:
            for kind, token in part.sort_values("seq")[["kind", "token"]].itertuples(index=False):
                if kind == "token":
                    held.append(token)
                else:
                    yield pd.DataFrame({"session": [key[0]], "text": [before + "".join(held)]})
                    before, held = "", []
        # read once, written once for each batch: linear in the tokens
        self.before.update((before + "".join(held[:-RING]),))
        if held:
            self.ring.put([(t,) for t in held[-RING:]])
        else:
            self.ring.clear()

    def close(self) -> None:
        pass


def gathered(tokens: DataFrame) -> DataFrame:
    """tokens (streaming): session, seq, kind (token, end, flush), token. Emits session, text at each end or flush."""
    return tokens.groupBy("session").transformWithStateInPandas(statefulProcessor=Gather(), outputStructType="session string, text string", outputMode="Append", timeMode="None")


def activity(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Extension: events by window and type under a watermark; works on streams and on tables."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    return timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
