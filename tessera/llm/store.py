"""Content-addressed store of token ids.

``build_store`` tokenises documents, cuts each id stream into chunks where a rolling hash over the
last ids meets a mask, and writes a store in a folder:

* ``data/part=N``: a row per document in ascending doc_id (parts are doc_id ranges, sorted within): its recipe
  (digest and length of every chunk, the Merkle root over the digests) and the payload of
  those chunks that appear here first. A chunk's bytes are stored once, where its smallest (doc_id, position) is.
* ``manifest``: a row per part: documents, ids, and a hash of both and of the Merkle root over the documents' roots.

``read_store`` fetches the payloads that a recipe refers to elsewhere (only documents with such
references are shuffled), checks every digest and root, and returns each document's ids.

Defined results: null or empty text is just the end id. ``build_store`` tells rows apart by doc_id; rows that share a doc_id,
or whose doc_id is null, raise there, since a recipe needs one name. ``store_all``, which the query uses, gives such tables' rows names of their own, in the order of
doc_id (nulls last) and, within one, of the text's hash, and keeps them in ``names``: every row is stored and read back. An empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import documents, lean, parts_for, rough_bytes, ship, stage, text_bytes, work_path
from tessera.llm.tokens import TEXTS, default_path, encoder, release

DIGEST = 16
MANIFEST = "part int, n_docs long, n_tokens long, root binary"
STORED = "doc_id long, n_tokens long, width int, lengths array<int>, digests array<binary>, root binary, payload binary, refs array<int>, part int"
DATA = "doc_id long, part int, n_tokens long, width int, lengths array<int>, digests array<binary>, root binary, payload binary"
MOST_PARTS = 1 << 16  # bounds of parts that the driver holds; parts of a larger store are dealt out to several tasks each


def _gear(width: int = 1 << 16) -> np.ndarray:
    """A fixed random 64-bit value for each id (ids beyond the table wrap)."""
    x = np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


GEAR = _gear()


WINDOW = 8  # ids the rolling hash sees


def cut_many(streams: list[np.ndarray], average: int, least: int, most: int) -> list[list[int]]:
    """Ends of the chunks of each id stream; they depend on the ids near them only, but for the two limits.

    The streams are hashed as one; the few hashes that see a stream before fall within ``least`` of the start, where nothing is cut.
    """
    if least < WINDOW:
        raise ValueError(f"a chunk has at least {WINDOW} ids")
    ids = np.concatenate(streams) if streams else np.zeros(0, np.int64)
    g = GEAR[ids.astype(np.int64) & 0xFFFF]
    h = g.copy()
    for k in range(1, WINDOW):
        h[k:] += g[:-k] << np.uint64(k)
    marks = np.flatnonzero((h & np.uint64((average - 1) << 16)) == 0) + 1
    bounds = np.cumsum([0, *map(len, streams)])
    inner = np.searchsorted(marks, bounds, side="right")
    out = []
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        ends, last, n = [], 0, b - a
        for m in (marks[inner[i]: inner[i + 1]] - a).tolist() + [n]:
            while m - last > most:
                last += most
                ends.append(last)
            if m - last >= least or (m == n and m > last):
                ends.append(m)
                last = m
        out.append(ends)
    return out


def cut_points(ids: np.ndarray, average: int, least: int, most: int) -> np.ndarray:
    return np.array(cut_many([ids], average, least, most)[0], np.int64)


def merkle(digests: list[bytes]) -> bytes:
    level = list(digests) or [b""]
    while len(level) > 1:
        level = [hashlib.blake2b(b"\x01" + b"".join(level[i: i + 2]), digest_size=DIGEST).digest() for i in range(0, len(level), 2)]
    return hashlib.blake2b(b"\x02" + level[0], digest_size=DIGEST).digest()


def sealed(n_docs: int, n_tokens: int, root: bytes) -> bytes:
    """A part's root, which its counts belong to."""
    return hashlib.blake2b(b"\x03" + n_docs.to_bytes(8, "little") + n_tokens.to_bytes(8, "little") + root, digest_size=DIGEST).digest()


def digest(payload: bytes) -> bytes:
    return hashlib.blake2b(payload, digest_size=DIGEST).digest()


_zstd: list = []


def _codec() -> tuple:
    if not _zstd:  # a context costs more than a document
        _zstd.append((zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()))
    return _zstd[0]


def squeeze(x: bytes) -> bytes:
    return _codec()[0].compress(x)


def unpack(x: bytes) -> bytes:
    return _codec()[1].decompress(x) if x else b""


_LENGTHS, _DIGESTS = pa.list_(pa.int32()), pa.list_(pa.binary())


def build_store(
    docs: DataFrame, path: str, *, tokenizer: str, end_id: int, average: int = 512, least: int = 64, most: int = 4096,
    part_bytes: int = 4 << 20, most_parts: int = MOST_PARTS,
) -> str:
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n, named = docs.agg(F.count(F.lit(1)), F.count("doc_id")).first()
    if named < n:
        raise ValueError("a document without doc_id can't have a recipe")
    tasks = parts_for(rough_bytes(docs), part_bytes)
    n_parts = min(tasks, most_parts)
    deal = -(-tasks // n_parts)  # tasks of a part
    bounds = sorted(set(docs.approxQuantile("doc_id", [k / n_parts for k in range(1, n_parts)], 0.2 / n_parts))) if n else []
    bounds = [int(b) for b in bounds]

    def encode(batches):
        enc, edges = encoder(tokenizer), np.array(bounds, np.int64)
        end = np.array([end_id], enc.dtype)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(keys), TEXTS):
                rows = []
                flat, cut = enc.encode(*text_bytes(texts.slice(at, TEXTS)))
                streams = [np.concatenate([flat[a:b], end]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
                for key, ids, ends in zip(keys[at: at + TEXTS], streams, cut_many(streams, average, least, most)):
                    raw, w = ids.tobytes(), enc.dtype.itemsize
                    cuts = [0, *(e * w for e in ends)]
                    found = [digest(raw[a:b]) for a, b in zip(cuts, cuts[1:])]
                    lengths = np.diff(ends, prepend=0).tolist()
                    rows.append((key, int(np.searchsorted(edges, key, side="left")), len(ids), w, lengths, found, merkle(found), squeeze(raw)))
                cols = list(zip(*rows))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), _LENGTHS, _DIGESTS, pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "part", "n_tokens", "width", "lengths", "digests", "root", "payload"])

    group = ["part"] if deal == 1 else ["part", F.pmod("doc_id", F.lit(deal))]
    whole = docs.mapInArrow(lean(encode, keep_encoders=True), DATA).repartition(tasks, *group)

    def digests(batches):  # all columns come in, so that the exchange below is one and the same
        for batch in batches:
            each = batch.column("digests")
            n = np.diff(each.offsets.to_numpy())
            pos = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
            doc, part = (np.repeat(batch.column(c).to_numpy(), n) for c in ("doc_id", "part"))
            yield pa.RecordBatch.from_arrays([each.flatten(), pa.array(doc, pa.int64()), pa.array(pos), pa.array(part, pa.int32())], ["h", "doc_id", "pos", "part"])

    uses = whole.mapInArrow(lean(digests), "h binary, doc_id long, pos int, part int")
    first = uses.groupBy("h").agg(F.min(F.struct("doc_id", "pos")).alias("at"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "at")
    refs = (
        uses.join(first, "h").where(~((F.col("doc_id") == F.col("at.doc_id")) & (F.col("pos") == F.col("at.pos"))))
        .groupBy("part", "doc_id").agg(F.array_sort(F.collect_list("pos")).alias("refs"))
    )

    def drop(data, gone):
        release()
        gone = dict(zip(gone.column("doc_id").to_pylist(), gone.column("refs").to_pylist()))
        data = data.sort_by("doc_id").combine_chunks()
        refs = [gone.get(d, []) for d in data.column("doc_id").to_pylist()]
        out = data.append_column("refs", pa.array(refs, pa.list_(pa.int32())))
        some = [i for i, r in enumerate(refs) if r]
        if some:
            left, cols = [], data.take(some).select(["width", "lengths", "payload"])
            for i, w, lengths, payload in zip(some, *(c.to_pylist() for c in cols.columns)):
                raw, away, a, kept = unpack(payload), set(refs[i]), 0, []
                for pos, k in enumerate(lengths):
                    if pos not in away:
                        kept.append(raw[a * w: (a + k) * w])
                    a += k
                left.append(squeeze(b"".join(kept)))
            mask = np.zeros(len(refs), bool)
            mask[some] = True
            payload = pc.replace_with_mask(data.column("payload").combine_chunks(), pa.array(mask), pa.array(left, pa.binary()))
            out = out.set_column(out.column_names.index("payload"), "payload", payload)
        return out

    kept = whole.groupBy(*group).cogroup(refs.groupBy(*group)).applyInArrow(drop, DATA + ", refs array<int>")
    kept.write.partitionBy("part").option("compression", "none").parquet(f"{path}/data")  # payloads are compressed, digests can't be
    _manifest(spark, path)
    return path


def _roots(data: DataFrame) -> DataFrame:
    """A row per part: documents, ids and the Merkle root over its documents' roots in ascending doc_id."""

    def roots(key, t):
        release()
        t = t.sort_by("doc_id")
        ids = t.column("doc_id").to_pylist()
        if len(set(ids)) < len(ids):
            raise ValueError("two documents share a doc_id")
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "n_docs": pa.array([len(ids)], pa.int64()), "n_tokens": pa.array([sum(t.column("n_tokens").to_pylist())], pa.int64()), "root": pa.array([sealed(len(ids), sum(t.column("n_tokens").to_pylist()), merkle(t.column("root").to_pylist()))], pa.binary())})

    return data.groupBy("part").applyInArrow(roots, MANIFEST)


def _manifest(spark: SparkSession, path: str) -> None:
    _roots(spark.read.schema(STORED).parquet(f"{path}/data").select("part", "doc_id", "n_tokens", "root")).write.parquet(f"{path}/manifest")


def read_store(spark: SparkSession, path: str, *, digest_only: bool = False) -> DataFrame:
    """doc_id, part, n_tokens, ids (little-endian unsigned 32-bit, or null with ``digest_only``) and ids_crc32 of every document.

    Raises where a chunk, a document's root or the manifest doesn't verify.
    """
    ship(spark)
    data = spark.read.schema(STORED).parquet(f"{path}/data")
    inline = data.where(F.size("refs") == 0).withColumn("found", F.lit(None).cast("array<struct<pos:int,chunk:binary>>"))
    rest = data.where(F.size("refs") > 0)

    want = rest.select("doc_id", F.explode("refs").alias("pos"), "digests").select("doc_id", "pos", F.element_at("digests", F.col("pos") + 1).alias("h"))
    keys = want.select("h").distinct()
    # where the wanted chunks are, then only those documents' payloads
    owned = data.select("doc_id", "refs", F.posexplode("digests").alias("pos", "h")).where(~F.array_contains("refs", F.col("pos")))
    places = owned.join(keys, "h").groupBy("doc_id").agg(F.collect_list("pos").alias("give"))

    def give(batches):
        for batch in batches:
            out = ([], [])
            for each, lengths, width, refs, payload, asked in zip(*(batch.column(c).to_pylist() for c in ("digests", "lengths", "width", "refs", "payload", "give"))):
                raw, refs, asked, a = unpack(payload), set(refs), set(asked), 0
                for pos, k in enumerate(lengths):
                    if pos in refs:
                        continue
                    if pos in asked:
                        out[0].append(each[pos])
                        out[1].append(raw[a: a + k * width])
                    a += k * width
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in out], ["h", "chunk"])

    chunks = data.join(places, "doc_id").select("digests", "lengths", "width", "refs", "payload", "give").mapInArrow(lean(give), "h binary, chunk binary")
    found = want.join(chunks, "h").groupBy("doc_id").agg(F.collect_list(F.struct("pos", "chunk")).alias("found"))
    both = inline.unionByName(rest.join(found, "doc_id", "left"))
    kind = "doc_id long, part int, n_tokens long, ids binary, ids_crc32 long"

    def restore(batches):
        for batch in batches:
            out: list[tuple] = []
            each, sizes = batch.column("digests"), batch.column("lengths")
            told, lengths = b"".join(each.flatten().to_pylist()), sizes.flatten().to_pylist()
            at = np.cumsum(np.append(0, np.diff(each.offsets.to_numpy()))).tolist()
            names = ("doc_id", "part", "n_tokens", "width", "root", "payload", "refs", "found")
            for x, y, (key, part, n, w, root, payload, refs, found) in zip(at, at[1:], zip(*(batch.column(c).to_pylist() for c in names))):
                raw, a, got = unpack(payload), 0, []
                if refs:
                    refs, other = set(refs), {f["pos"]: f["chunk"] for f in found or []}
                for pos, k in enumerate(lengths[x:y]):
                    if refs and pos in refs:
                        got.append(other[pos])
                    else:
                        got.append(raw[a: a + k * w])
                        a += k * w
                here = [digest(c) for c in got]
                raw = b"".join(got) if refs else raw
                if b"".join(here) != told[x * DIGEST: y * DIGEST] or merkle(here) != root or len(raw) != n * w:
                    raise ValueError(f"document {key} doesn't verify")
                ids = np.frombuffer(raw, f"<u{w}").astype("<u4").tobytes()
                out.append((key, part, n, None if digest_only else ids, zlib.crc32(ids)))
            c = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64()))], ["doc_id", "part", "n_tokens", "ids", "ids_crc32"])

    columns = ["doc_id", "part", "n_tokens", "width", "lengths", "digests", "root", "payload", "refs", "found"]
    return both.select(*columns).mapInArrow(lean(restore), kind)


def verify_manifest(spark: SparkSession, path: str) -> None:
    """Counts and roots in the data, part by part, against the manifest."""
    data = spark.read.schema(STORED).parquet(f"{path}/data").select("part", "doc_id", "n_tokens", "root")
    told = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").select("part", F.struct("n_docs", "n_tokens", "root").alias("told"))
    found = _roots(data).select("part", F.struct("n_docs", "n_tokens", "root").alias("found"))
    if found.join(told, "part", "full").where("NOT (found <=> told)").limit(1).count():
        raise ValueError("a part doesn't match the manifest")


def offsets(store_rows: DataFrame, spark: SparkSession, path: str, together: int = 4096) -> DataFrame:
    """Adds ``start``: ids of all documents before it. Sums within parts, plus the parts' totals from the manifest, which are summed in groups of
    ``together`` parts, so that the one window without a key has a row for each group."""
    parts = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").select("part", "n_tokens", (F.col("part") / together).cast("int").alias("group"))

    def before(*, key: list[str], order: str):
        return Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)

    so_far = lambda w: F.coalesce(F.sum("n_tokens").over(w), F.lit(0))
    groups = parts.groupBy("group").agg(F.sum("n_tokens").alias("n_tokens")).select("group", so_far(before(key=[], order="group")).alias("first"))
    parts = parts.withColumn("inner", so_far(before(key=["group"], order="part"))).join(groups, "group").select("part", (F.col("first") + F.col("inner")).alias("base"))
    rows = store_rows.withColumn("within", so_far(before(key=["part"], order="doc_id")))
    return rows.join(parts, "part").withColumn("start", F.col("base") + F.col("within"))


def store_all(docs: DataFrame, path: str, **options) -> DataFrame | None:
    """``build_store`` for any table. Where a doc_id is null or repeated, recipes go by names that ascend with the rows' order; returns (name, doc_id), or None."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").isEmpty():
        build_store(docs, path, **options)
        return None
    ordered = docs.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))
    named = stage(ordered.select(F.monotonically_increasing_id().alias("name"), "doc_id", "text"), "named")  # ascends over the sorted ranges
    named.select("name", "doc_id").write.parquet(f"{path}/names")
    build_store(named.select(F.col("name").alias("doc_id"), "text"), path, **options)
    return spark.read.schema("name long, doc_id long").parquet(f"{path}/names")


def stored_rows(docs: DataFrame, path: str, **options) -> DataFrame:
    """doc_id, part, n_tokens, ids_crc32, start of every row, by way of a store at ``path``."""
    spark = docs.sparkSession
    names = store_all(docs, path, **options)
    verify_manifest(spark, path)
    rows = offsets(read_store(spark, path, digest_only=True).drop("ids"), spark, path)
    return rows if names is None else rows.withColumnRenamed("doc_id", "name").join(names, "name").drop("name")


def op9_content_store(spark, sf_dir):
    rows = stored_rows(documents(spark, sf_dir), work_path(spark, "store"), tokenizer=default_path(), end_id=2)
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32")
