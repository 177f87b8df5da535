"""Training records as JSON lines, and the retrieval index as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.dedup import resume

RECORD = "instruction string, input string, output string"
INDEX = "chunk_id long, paragraph_id string, text string, formatted_text string, source_doc string, embedding array<float>, model_name string"


def write_jsonl(df: DataFrame, path: str, single: bool = False) -> None:
    """One object per line, columns in order, nulls written; ``single`` asks for one file (small outputs only)."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """Blank lines don't count."""
    return spark.read.schema(schema).json(path)


def append_jsonl(df: DataFrame, path: str, keys: list[str], schema: str) -> int:
    """Append the rows whose keys the file lacks; how many were there before. Resuming by key is safe whatever the order of the rows."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    before = 0
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        done = read_jsonl(spark, path, schema)
        before = done.count()
        df = resume(df, done, keys)
    df.write.mode("append").option("ignoreNullFields", "false").json(path)
    return before


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(~T.is_blank(F.col("value")))


def write_index(chunks: DataFrame, path: str, model_name: str) -> None:
    chunks.withColumn("model_name", F.lit(model_name)).select(*[c.split()[0] for c in INDEX.split(", ")]).write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Raises FileNotFoundError if the index isn't there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        raise FileNotFoundError(f"no index at {path}")
    return spark.read.schema(INDEX).parquet(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A report as one file in any file system Spark writes."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(text.encode("utf-8"))
    finally:
        out.close()
