"""Page texts of document files, through a plug-in for each format."""

from __future__ import annotations

from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.workers import model, ship

PAGES = "source_doc string, page_no int, text string"


class PageExtractor(Protocol):
    def pages(self, content: bytes) -> list[str]:
        """The texts of a file's pages in order; raises on a file it can't read."""


class PdfExtractor:
    """PDF pages by whichever of two common libraries the workers have."""

    def pages(self, content: bytes) -> list[str]:
        import io

        try:
            import fitz
        except ImportError:
            from pypdf import PdfReader

            return [p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages]
        with fitz.open(stream=content, filetype="pdf") as doc:
            return [p.get_text() for p in doc]


class PlainTextExtractor:
    """UTF-8 files whose pages are parted by form feeds."""

    def pages(self, content: bytes) -> list[str]:
        return content.decode("utf-8").split("\f")


def scan_files(spark: SparkSession, folder: str, suffix: str = "pdf") -> DataFrame | None:
    """Files of a folder (not below it) with the suffix in any case; None if there is no such folder or file."""
    glob = "*." + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return files if files.select("path").limit(1).count() else None


def extract_pages(files: DataFrame, extractor: PageExtractor) -> tuple[DataFrame, DataFrame]:
    """(pages, failures). ``extractor`` is an object or ``workers.Lazy``. A file that can't be read gives no pages and a row of failures (source_doc, error); empty pages are dropped."""
    kind = PAGES + ", error string"

    ship(files.sparkSession)

    def run(batches):
        own = model(extractor)
        for b in batches:
            rows = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                name = path.rsplit("/", 1)[-1]
                try:
                    rows += [(name, i, t, None) for i, t in enumerate(own.pages(content))]
                except Exception as e:  # a bad file is a row, not the end of the job
                    rows.append((name, None, None, f"{type(e).__name__}: {e}"[:500]))
            cols = list(zip(*rows)) or [()] * 4
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["source_doc", "page_no", "text", "error"])

    got = files.select("path", "content").mapInArrow(run, kind)
    pages = nonempty(got.where(F.col("error").isNull())).drop("error")
    return pages, got.where(F.col("error").isNotNull()).select("source_doc", "error")


def nonempty(pages: DataFrame, text: str = "text") -> DataFrame:
    """Pages with something on them."""
    return pages.where(~T.is_blank(F.col(text)))


def document_text(pages: DataFrame, squash: bool = False) -> DataFrame:
    """(source_doc, text): pages joined in order, raw by line feeds, or with white space normalised by blanks.

    A document's pages are gathered in one row, which is what a document's text is.
    """
    text = T.squash(F.col("text")) if squash else F.col("text")
    ordered = F.array_sort(F.collect_list(F.struct("page_no", text.alias("text"))))
    return pages.groupBy("source_doc").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), " " if squash else "\n").alias("text"))
