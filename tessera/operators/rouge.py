"""ROUGE-L: how much of a reference's words a candidate has in the same order.

The longest common subsequence of two lists of words is found with bit vectors: a row of the table is one whole number with a bit for each word of the shorter
list, and a word of the other list updates it by an addition and a few bit operations, so the work is the product of the lengths over the bits of a machine word.

Two measures: of whole texts, and the summary-level one, where for each sentence of the reference the words that any sentence of the candidate
matches are united (a word occurrence counts once). Precision and recall are over the words of candidate and reference; f weighs recall ``beta`` times.

Defined results: without words on either side all measures are 0; null texts are empty; repeated pairs are measured each.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.workers import ship


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence."""
    if len(a) > len(b):
        a, b = b, a
    n = len(a)
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << n) - 1
    row = full  # a zero bit where the length rises
    for y in b:
        here = places.get(y)
        if here is not None:
            hit = row & here
            row = ((row + hit) | (row - hit)) & full
    return n - row.bit_count()


def lcs_places(a: list, b: list) -> set[int]:
    """Places in ``a`` of one longest common subsequence: the rows of the bit table are kept and walked back from the end."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    rows = [full]
    for y in b:
        hit = rows[-1] & places.get(y, 0)
        rows.append(((rows[-1] + hit) | (rows[-1] - hit)) & full)
    out, i, j = set(), len(a), len(b)
    while i and j:
        bit = 1 << (i - 1)
        if rows[j] & bit:  # the length doesn't rise at this word of a
            i -= 1
        elif not rows[j - 1] & bit:  # nor does it need this word of b
            j -= 1
        else:
            out.add(i - 1)
            i, j = i - 1, j - 1
    return out


def union_hits(reference: list[list], candidate: list[list]) -> int:
    """Words of the reference's sentences that the candidate's sentences match, each sentence's matches united, no word more often than either side has it."""
    left_r, left_c = Counter(w for s in reference for w in s), Counter(w for s in candidate for w in s)
    hits = 0
    for sentence in reference:
        united = set().union(*(lcs_places(sentence, other) for other in candidate)) if candidate else set()
        for i in sorted(united):
            w = sentence[i]
            if left_r[w] > 0 and left_c[w] > 0:
                left_r[w] -= 1
                left_c[w] -= 1
                hits += 1
    return hits


def _measures(hits: int, n_reference: int, n_candidate: int, beta: float) -> tuple[float, float, float]:
    if not hits:
        return 0.0, 0.0, 0.0
    p, r = hits / n_candidate, hits / n_reference
    return p, r, (1 + beta * beta) * p * r / (r + beta * beta * p)


def rouge_l(pairs: DataFrame, reference: str = "reference", candidate: str = "candidate", beta: float = 1.0, summary: bool = False) -> DataFrame:
    """``pairs`` with lcs (long), precision, recall and f. With ``summary``, sentences (lines, and what full stops part) are compared and united. Row by row, no shuffle; columns of these names are replaced."""
    ship(pairs.sparkSession)
    names = [c for c in pairs.columns if c not in ("lcs", "precision", "recall", "f")]
    kind = pairs.select(*names).schema
    width = len(names)
    split = (lambda c: F.transform(F.split(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[.\n]"), T.words)) if summary else (lambda c: T.words(F.coalesce(F.col(c).cast("string"), F.lit(""))))
    own = [_free(names, "r_words"), _free(names, "c_words")]

    def run(batches):
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):  # one pair of texts at a time
                r, c = batch.column(width)[i].as_py(), batch.column(width + 1)[i].as_py()
                if summary:
                    r, c = [s for s in r if s], [s for s in c if s]
                    hits, n, m = union_hits(r, c), sum(map(len, r)), sum(map(len, c))
                else:
                    hits, n, m = lcs_length(r, c), len(r), len(c)
                rows.append((hits, *_measures(hits, n, m, beta)))
            got = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(got[0], pa.int64()), *(pa.array(x, pa.float64()) for x in got[1:])], [*names, "lcs", "precision", "recall", "f"])

    out = kind.add("lcs", "long").add("precision", "double").add("recall", "double").add("f", "double")
    return pairs.select(*names, split(reference).alias(own[0]), split(candidate).alias(own[1])).mapInArrow(run, out)


def _free(names: list[str], name: str) -> str:
    while name.lower() in {c.lower() for c in names}:
        name += "_"
    return name
