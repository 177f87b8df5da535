import pytest
from pyspark.sql import functions as F

from tessera.sources import pages as S
from tessera.sources import records as R
from tessera.streaming.incremental import follow


def test_pages(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes("page one\f  \fpage  two".encode())
    (tmp_path / "B.PDF").write_bytes(b"\xff\xfe bad utf-8")
    (tmp_path / "c.txt").write_bytes(b"other")
    assert S.scan_files(spark, str(tmp_path / "none")) is None and S.scan_files(spark, str(tmp_path), "doc") is None
    pages, bad = S.extract_pages(S.scan_files(spark, str(tmp_path)), S.PlainTextExtractor())
    assert [tuple(r) for r in pages.orderBy("page_no").collect()] == [("a.pdf", 0, "page one"), ("a.pdf", 2, "page  two")]
    assert [r["source_doc"] for r in bad.collect()] == ["B.PDF"]
    assert S.document_text(pages).first()["text"] == "page one\npage  two"
    assert S.document_text(pages, squash=True).first()["text"] == "page one page two"


def test_jsonl(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([("i1", "", "é"), ("i2", None, "x")], R.RECORD)
    R.write_jsonl(df, path, single=True)
    (file,) = (tmp_path / "out").glob("part-*")
    assert file.read_text(encoding="utf-8").splitlines()[0] == '{"instruction":"i1","input":"","output":"é"}'
    file.write_text(file.read_text(encoding="utf-8") + "\n\n", encoding="utf-8")
    for crc in (tmp_path / "out").glob(".*.crc"):
        crc.unlink()
    assert R.read_jsonl(spark, path).count() == 2 and R.read_lines(spark, path).count() == 2
    more = spark.createDataFrame([("i2", "", "y"), ("i3", "", "z")], R.RECORD)
    assert R.append_jsonl(more, path, ["instruction"], R.RECORD) == 2
    assert sorted(r["instruction"] for r in R.read_jsonl(spark, path).collect()) == ["i1", "i2", "i3"]


def test_index(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        R.read_index(spark, str(tmp_path / "none"))
    rows = spark.createDataFrame([(1, "17001", "t", "f", "d", [1.0])], "chunk_id long, paragraph_id string, text string, formatted_text string, source_doc string, embedding array<float>")
    R.write_index(rows, str(tmp_path / "ix"), "m")
    assert R.read_index(spark, str(tmp_path / "ix")).first()["model_name"] == "m"
    R.write_text(spark, "réport", str(tmp_path / "r.md"))
    assert (tmp_path / "r.md").read_text(encoding="utf-8") == "réport"


def test_follow(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    schema = "id long, text string"

    def go():
        follow(spark, str(src), schema, lambda d: d.withColumn("text", F.upper("text")), out, ["id"], schema, str(tmp_path / "ck")).awaitTermination()

    (src / "1.json").write_text('{"id":1,"text":"a"}\n{"id":2,"text":"b"}\n')
    go()
    (src / "2.json").write_text('{"id":2,"text":"c"}\n{"id":3,"text":"d"}\n')
    go()
    assert sorted(map(tuple, R.read_jsonl(spark, out, schema).collect())) == [(1, "A"), (2, "B"), (3, "D")]
