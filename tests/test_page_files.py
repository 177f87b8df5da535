"""The page file source: partitions, bad files, and a stream that starts again."""

import os
from pathlib import Path

import pytest

from tessera.sources import page_files


@pytest.fixture(scope="module")
def pages(spark):
    page_files.register(spark)
    return lambda: spark.read.format("page_files")


def put(folder, name, data, at):
    Path(folder).mkdir(exist_ok=True)
    p = Path(folder) / name
    p.write_bytes(data)
    os.utime(p, ns=(at, at))


def test_batches(spark, pages, tmp_path):
    folder = f"{tmp_path}/in"
    for i in range(7):
        put(folder, f"d{i}.TXT" if i % 2 else f"d{i}.txt", f"p{i}\f \fq{i}".encode(), i)
    put(folder, "bad.txt", b"\xff\xfe", 9)
    put(folder, "other.pdf", b"x", 9)
    df = pages().option("path", folder).option("partition_bytes", 14).load()
    assert df.rdd.getNumPartitions() == 4
    rows = [tuple(r) for r in df.collect()]
    assert sorted(r for r in rows if r[3] is None) == sorted((f"d{i}.{'TXT' if i % 2 else 'txt'}", n, f"{t}{i}", None) for i in range(7) for n, t in ((0, "p"), (2, "q")))
    assert [(r[0], r[1], r[3].split(":")[0]) for r in rows if r[3]] == [("bad.txt", None, "UnicodeDecodeError")]
    assert pages().option("path", f"{tmp_path}/none").load().count() == 0


def test_stream_goes_on_after_a_restart(spark, pages, tmp_path):
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"

    def go():
        # sources in Python take no availableNow trigger: the query is stopped when it has nothing left to do
        q = spark.readStream.format("page_files").option("path", folder).load().writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/state").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return sorted(r["text"] for r in spark.read.parquet(out).collect())

    put(folder, "a.txt", b"1\f2", 100)
    assert go() == ["1", "2"]
    put(folder, "b.txt", b"3", 200)
    put(folder, "c.txt", b"4", 200)
    assert go() == ["1", "2", "3", "4"]
    assert go() == ["1", "2", "3", "4"]
