"""Line deduplication by overlapping windows of three lines.

Lines are split at LF; blank ones are left alone and don't count. Every three consecutive lines (trimmed of ASCII blanks) are
hashed to 128 bits. The first occurrence of a window in (doc_id, position) order stays, null doc_ids coming last; the lines
under every later one go, overlapping windows being merged. Windows are judged on the input, not on what is left.

Only windows that occur twice or more are joined back, so texts move once, with the positions they lose. A window
that very many documents share is counted before it is shuffled, and its later occurrences are a plain join row each.

Defined results: null and empty texts and texts of fewer than three lines lose nothing; null stays null. A row goes by its doc_id, null or not, and
its text's hash: rows that share a doc_id but not a text are documents of their own (at equal positions the smaller hash is first); rows that repeat both
lose the same lines and don't count against each other at equal positions. Other columns pass through, whatever their names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import documents, lean, ship, stage, unused

BLANKS = " \t\n\v\f\r"


def split_lines(text: str | None) -> tuple[list[str], list[int]]:
    """All lines, and the indices of those with something on them."""
    lines = (text or "").split("\n")
    return lines, [i for i, x in enumerate(lines) if x.strip(BLANKS)]


def line_windows(docs: DataFrame, text: str, window: int) -> DataFrame:
    """doc_id, t (hash of the text), pos (among the lines that count) and the two halves of the window's hash."""

    def run(batches):
        for batch in batches:
            out = ([], [], [], [], [])
            for key, own_hash, t in zip(*(batch.column(c).to_pylist() for c in range(3))):
                lines, use = split_lines(t)
                if len(use) < window:
                    continue
                own = [xxhash.xxh3_128_digest(lines[i].strip(BLANKS).encode("utf-8", "surrogatepass")) for i in use]
                for pos in range(len(own) - window + 1):
                    h = xxhash.xxh3_128_digest(b"".join(own[pos: pos + window]))
                    for kept, x in zip(out, (key, own_hash, pos, int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True))):
                        kept.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["doc_id", "t", "pos", "h1", "h2"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col(text).cast("string")), F.col(text).cast("string"))
    return rows.mapInArrow(lean(run), "doc_id long, t long, pos int, h1 long, h2 long")


def later_windows(docs: DataFrame, text: str = "text", window: int = 3) -> DataFrame:
    """doc_id and t of a row, and the positions of its windows that occurred before."""
    ship(docs.sparkSession)
    all_windows = stage(line_windows(docs, text, window), "windows")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "pos", "t")  # a null doc_id is last
    first = all_windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return (
        all_windows.join(first, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
        .groupBy("doc_id", "t").agg(F.collect_set("pos").alias("later"))
    )


def without(text: str | None, later, window: int):
    """The text less the lines under the windows at ``later``; lines that count, and lines removed."""
    lines, use = split_lines(text)
    gone = {p + k for p in later or () for k in range(window) if p + k < len(use)}
    if not gone:
        return text, len(use), 0
    drop = {use[g] for g in gone}
    return "\n".join(x for i, x in enumerate(lines) if i not in drop), len(use), len(gone)


def line_dedup(docs: DataFrame, text: str = "text", window: int = 3, drop_emptied: bool = False) -> DataFrame:
    """``docs`` with the lines removed; with ``drop_emptied``, rows that lost all their lines go."""
    docs = docs.withColumn(text, F.col(text).cast("string"))
    at, n = docs.columns.index(text), len(docs.columns)
    extra = unused(docs.columns, "later")
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("w.doc_id")) & (F.xxhash64(F.col(f"d.`{text}`")) == F.col("w.t"))
    joined = docs.alias("d").join(later_windows(docs, text, window).alias("w"), same, "left").select("d.*", F.col("w.later").alias(extra))

    def run(batches):
        for batch in batches:
            got = [without(t, w, window) for t, w in zip(batch.column(at).to_pylist(), batch.column(n).to_pylist())]
            cols = [pa.array([g[0] for g in got], pa.string()) if i == at else batch.column(i) for i in range(n)]
            out = pa.RecordBatch.from_arrays(cols, batch.schema.names[:n])
            yield out.filter(pa.array([g[2] < g[1] or not g[1] for g in got], pa.bool_())) if drop_emptied else out

    return joined.mapInArrow(lean(run), docs.schema)


def line_digests(docs: DataFrame, window: int = 3) -> DataFrame:
    """doc_id, n_lines (that count), n_removed and the SHA-256 of the text that is left."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    later = later_windows(docs, "text", window).withColumnRenamed("doc_id", "id")
    joined = docs.join(later, docs["doc_id"].eqNullSafe(later["id"]) & (F.xxhash64(docs["text"]) == later["t"]), "left").select("doc_id", "text", "later")

    def run(batches):
        for batch in batches:
            got = [without(t, w, window) for t, w in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            sha = [hashlib.sha256((g[0] or "").encode("utf-8", "surrogatepass")).hexdigest() for g in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_lines", "n_removed", "kept_sha256"])

    return joined.mapInArrow(lean(run), "doc_id long, n_lines long, n_removed long, kept_sha256 string")


def op7_line_windows(spark, sf_dir):
    return line_digests(documents(spark, sf_dir))


#: The same rows in DuckDB.
OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS ord FROM documents
), used AS (
  SELECT doc_id, ord, trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS line, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS pos
  FROM lines WHERE trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') <> ''
), windows AS (
  SELECT doc_id, pos, line AS a, lead(line) OVER w AS b, lead(line, 2) OVER w AS c FROM used WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), ranked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id NULLS LAST, pos) AS nth FROM windows WHERE c IS NOT NULL
), gone AS (
  SELECT DISTINCT doc_id, pos + k AS pos FROM ranked, (VALUES (0), (1), (2)) AS v(k) WHERE nth > 1
), judged AS (
  SELECT l.doc_id, l.ord, l.line, u.pos IS NOT NULL AS counts, g.pos IS NOT NULL AS gone
  FROM lines l LEFT JOIN used u ON l.doc_id = u.doc_id AND l.ord = u.ord LEFT JOIN gone g ON u.doc_id = g.doc_id AND u.pos = g.pos
)
SELECT doc_id, sum(counts::BIGINT)::BIGINT AS n_lines, sum(gone::BIGINT)::BIGINT AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY ord) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
