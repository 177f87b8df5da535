"""Cost-balanced packing of token ids into fixed-length training sequences.

Cost of a piece of n tokens: ``linear * n + quadratic * n * n`` (attention inside the piece).
Each task streams its documents, tokenises them and packs windows of ``window_tokens`` ids:
full-length pieces become sequences of their own, the remainders go in descending order of cost to the
cheapest open sequence with room, and what fits nowhere whole is cut into the room that is left.
A window wastes less than one sequence. No shuffle; memory is bounded by the window and
the longest single document; the result depends only on the rows of the partition.

Defined results: null or empty text is just the end id; a null doc_id is kept as null; repeated rows are
packed each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import documents, lean, ship, text_bytes
from tessera.llm.tokens import TEXTS, default_path, encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def assign(lengths, capacity: int, linear: float = 1.0, quadratic: float = 1.0 / 1024):
    """Pieces (item, start, length, sequence, offset) for items of the given lengths; gapless from 0 in each sequence."""
    out, rest, n_full = [], [], 0
    for i, n in enumerate(lengths):
        full = n // capacity
        for k in range(full):
            out.append((i, k * capacity, capacity, n_full, 0))
            n_full += 1
        if n % capacity:
            rest.append((n % capacity, i, full * capacity))
    if not rest:
        return out
    total = sum(r[0] for r in rest)
    bins = -(-total // capacity)
    room = [capacity] * bins
    cost = [0.0] * bins
    heap = [(0.0, b) for b in range(bins)]
    parked: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room; open again once pieces are short enough
    rest.sort(key=lambda r: (-r[0], r[1]))
    held, over, prev = [[] for _ in range(bins)], [], capacity
    for n, i, s in rest:
        for r in range(n, prev):
            for b in parked[r]:
                heapq.heappush(heap, (cost[b], b))
            parked[r] = []
        prev = n
        while heap and room[heap[0][1]] < n:
            b = heapq.heappop(heap)[1]
            parked[room[b]].append(b)
        if not heap:
            over.append((n, i, s))
            continue
        b = heapq.heappop(heap)[1]
        held[b].append((i, s, n))
        room[b] -= n
        cost[b] += linear * n + quadratic * n * n
        if room[b]:
            heapq.heappush(heap, (cost[b], b))
    order = iter(sorted((b for b in range(bins) if room[b]), key=lambda b: (cost[b], b)))
    b = next(order, None)
    for n, i, s in over:  # cut into what is left, cheapest sequence first
        while n:
            take = min(n, room[b])
            held[b].append((i, s, take))
            room[b] -= take
            n, s = n - take, s + take
            if not room[b]:
                b = next(order, None)
    for b, pieces in enumerate(held):
        at = 0
        for i, s, n in pieces:
            out.append((i, s, n, n_full + b, at))
            at += n
    return out


def pack(
    docs: DataFrame, *, tokenizer: str, end_id: int = 0, capacity: int = 1024, window_tokens: int = 1 << 21,
    linear: float = 1.0, quadratic: float = 1.0 / 1024,
) -> DataFrame:
    """One row per piece; see the module's text. ``sequence_id`` is unique over the result, not dense."""
    ship(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 36
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype)
        ids, keys, size, used = [], [], 0, 0

        def flush():
            nonlocal ids, keys, size, used
            rows, top = [], used
            for i, s, n, q, at in assign([len(x) for x in ids], capacity, linear, quadratic):
                piece = ids[i][s: s + n].astype("<u4").tobytes()
                rows.append((keys[i], s, n, zlib.crc32(piece), len(ids[i]), base + used + q, at))
                top = max(top, used + q + 1)
            used = top
            ids, keys, size = [], [], 0
            cols = list(zip(*rows))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

        for batch in batches:
            texts, doc = batch.column(1), batch.column(0).to_pylist()
            for at in range(0, len(doc), TEXTS):
                flat, cut = enc.encode(*text_bytes(texts.slice(at, TEXTS)))
                for d, a, b in zip(doc[at: at + TEXTS], cut[:-1].tolist(), cut[1:].tolist()):
                    ids.append(np.concatenate([flat[a:b], end]))
                    keys.append(d)
                    size += b - a + 1
                if size >= window_tokens:
                    yield flush()
        if ids:
            yield flush()

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(lean(run, keep_encoders=True), SCHEMA)


def op4_cost_packing(spark, sf_dir):
    return pack(documents(spark, sf_dir), tokenizer=default_path())
