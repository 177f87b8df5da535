"""Chunks with overlap that keep paragraphs, sentences and words together where they can.

A text is split at the strongest separator (paragraph marks by default); parts that are over the limit are split at the next one, down to single characters, and what
comes of it are atoms, none over the limit less the overlap. Atoms, with the separators that follow them, are merged greedily into chunks of at most ``size`` units. A
chunk begins with the last ``overlap`` units of the one before at most, in whole atoms where they fit and else in whole units, so that both always say where they meet.

Units are words or characters. A chunk is a slice of the text, given with its offsets (code points); chunks cover the text from its first to its last unit and each begins
where the one before it ends or earlier, so the text can be put together again. Chapter and paragraph of a chunk's beginning are given too.

Everything is row by row; nothing is shuffled. Defined results: null, empty and blank texts have no chunks; a text within the limit is one chunk.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.chunk import unused
from tessera.operators.workers import ship

ADDED = ("chunk_idx", "start", "end", "n_units", "n_overlap", "chapter", "paragraph", "chunk")


@dataclass(frozen=True)
class Splitting:
    """Separators from the strongest to the weakest, the unit of length and the marks of chapters (patterns)."""

    separators: tuple[str, ...] = (r"\n[ \t]*\n+", r"\n", r"(?<=[.!?])\s+", r"(?<=[,;:])\s+", r"\s+")
    unit: str = r"\S+"
    chapter: str = r"(?im)^[ \t]*((?:chapter|part|section)[ \t]+\w+[^\n]*)"
    paragraph: str = r"\n[ \t]*\n+"


WORDS = Splitting()
CHARACTERS = Splitting(unit=r"(?s).")


def unit_spans(text: str, how: Splitting = WORDS) -> tuple[np.ndarray, np.ndarray]:
    spans = [m.span() for m in re.finditer(how.unit, text)]
    return np.array([a for a, _ in spans], np.int64), np.array([b for _, b in spans], np.int64)


def atoms(text: str, starts: np.ndarray, size: int, how: Splitting = WORDS) -> list[tuple[int, int]]:
    """Ranges of units, each of at most ``size``, cut at the strongest separators that do."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(starts), 0)]
    while todo:
        a, b, level = todo.pop()
        if b - a <= size:
            if b > a:
                out.append((a, b))
            continue
        if level == len(how.separators):
            out += [(s, min(b, s + size)) for s in range(a, b, size)]
            continue
        lo, hi = int(starts[a]), int(starts[b]) if b < len(starts) else len(text)
        ends = [m.end() for m in re.compile(how.separators[level]).finditer(text, lo, hi)]
        cuts = sorted({a, b, *(int(c) for c in np.searchsorted(starts[a:b], ends) + a)})
        todo += [(x, y, level + 1) for x, y in reversed(list(zip(cuts, cuts[1:])))]
    return out


def chunks(text: str, size: int = 500, overlap: int = 100, how: Splitting = WORDS) -> list[tuple[int, int, int]]:
    """(first unit, end unit, units shared with the chunk before) of each chunk."""
    starts, _ = unit_spans(text, how)
    parts, out = atoms(text, starts, size - overlap, how), []  # so that any of them fits behind an overlap
    i = 0
    begin = end = shared = 0
    while i < len(parts):
        while i < len(parts) and parts[i][1] - begin <= size:
            end = parts[i][1]
            i += 1
        out.append((begin, end, shared))
        if i == len(parts):
            break
        room = min(overlap, end - begin - 1)  # the chunk before is not contained
        fitting = [a for a, b in parts[max(0, i - room): i] if end - a <= room]
        begin_next = min(fitting, default=end - max(0, room))
        shared = end - begin_next
        begin = begin_next
    return out


def recursive_chunks(df: DataFrame, text: str = "text", size: int = 500, overlap: int = 100, how: Splitting = WORDS) -> DataFrame:
    """The other columns of ``df`` and chunk_idx, start and end (offsets in the text), n_units, n_overlap (units shared with the chunk before), chapter (the latest mark of one at or before the
    beginning, else null), paragraph (how many paragraph marks come before) and ``chunk``. Columns of these names are replaced."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be 0 or more and less than the size")
    ship(df.sparkSession)
    kept = [c for c in df.columns if c.lower() not in ADDED and c != text]
    own = unused(df.columns, "whole")
    kind = df.select(*[F.col(f"`{c}`") for c in kept]).schema
    marks, paragraphs = re.compile(how.chapter), re.compile(how.paragraph)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows, which = [], []
                for i, t in enumerate(part.column(len(kept)).to_pylist()):
                    if not t:
                        continue
                    begins, ends = unit_spans(t, how)
                    if not len(begins):
                        continue
                    heads = [(m.start(), m.group(1).strip()) for m in marks.finditer(t)]
                    places, breaks = [h for h, _ in heads], [m.end() for m in paragraphs.finditer(t)]
                    for n, (a, b, shared) in enumerate(chunks(t, size, overlap, how)):
                        x, y = int(begins[a]), int(ends[b - 1])
                        h = int(np.searchsorted(places, x, side="right"))
                        rows.append((n, x, y, b - a, shared, heads[h - 1][1] if h else None, int(np.searchsorted(breaks, x, side="right")), t[x:y]))
                        which.append(i)
                got = list(zip(*rows)) or [()] * len(ADDED)
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string())
                taken = part.take(pa.array(which, pa.int64()))
                yield pa.RecordBatch.from_arrays([*taken.columns[: len(kept)], *(pa.array(x, k) for x, k in zip(got, kinds))], [*kept, *ADDED])

    for name, t in zip(ADDED, ("integer", "integer", "integer", "integer", "integer", "string", "integer", "string")):
        kind = kind.add(name, t)
    return df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias(own)).mapInArrow(run, kind)
