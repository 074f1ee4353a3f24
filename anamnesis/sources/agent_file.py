"""Markdown agent files to atoms (S34-S43): sections, bullets, code blocks and sentence chunks, classified."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = 480
_PROCEDURE = re.compile(r"(?i)\b(run|first|then|step|install|execute|command)\b")
_RULE = re.compile(r"(?i)\b(never|do not|don't|avoid|must not)\b")


def segments(text: str) -> Iterator[tuple[str, str, bool]]:
    """(section path, text, whether code) of each bullet, paragraph and fenced block."""
    path: list[str] = []
    held: list[str] = []
    code: list[str] | None = None
    for line in [*text.split("\n"), ""]:
        if line.strip().startswith("```"):
            if code is None:
                code = []
            else:
                if code:
                    yield " > ".join(path), "\n".join(code), True
                code = None
            continue
        if code is not None:
            code.append(line)
            continue
        head = re.match(r"(#{1,6})\s+(.*)", line)
        bullet = re.match(r"\s*(?:[-*+]|\d+[.)])\s+(.*)", line)
        if (head or bullet or not line.strip()) and held:
            yield " > ".join(path), " ".join(held), False
            held = []
        if head:
            path = path[: len(head[1]) - 1] + [head[2].strip()]
        elif bullet:
            held = [bullet[1].strip()]
        elif line.strip():
            held.append(line.strip())
    if code:
        yield " > ".join(path), "\n".join(code), True


def atoms(text: str, most: int = MOST) -> list[str]:
    """Long text in pieces of whole sentences; a sentence ends after 40 characters or more."""
    if len(text) <= most:
        return [text]
    out, now = [], ""
    for s in re.split(r"(?<=[.!?])\s+", text):
        if now and len(now) >= 40 and len(now) + 1 + len(s) > most:
            out.append(now)
            now = s
        else:
            now = f"{now} {s}".strip()
    return [*out, now] if now else out


def plan(files: DataFrame) -> DataFrame:
    """files: path, value (whole text). Atoms: path, place, section, content, memory_type, tags."""
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, value in zip(b.path, b.value, strict=True):
                place = 0
                for section, text, code in segments(value or ""):
                    for a in [text] if code else atoms(text):
                        kind = "procedural" if code or _PROCEDURE.search(a) else "anti_pattern" if _RULE.search(a) else "semantic"
                        slug = re.sub(r"[^a-z0-9]+", "-", section.lower()).strip("-")[:48].rstrip("-")
                        rows.append((path, place, section, a, kind, [f"section:{slug}"] if slug else []))
                        place += 1
            yield pd.DataFrame(rows, columns=["path", "place", "section", "content", "memory_type", "tags"])

    return files.select(F.col("path"), F.col("value")).mapInPandas(run, "path string, place int, section string, content string, memory_type string, tags array<string>")
