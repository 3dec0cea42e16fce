"""Writers: keyed JSON, CSV, incremental append, dead letters, table loads and in-place updates."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.text import key12


def keyed_json(docs: DataFrame, path: str) -> None:
    """One JSON object per document, by actor, context and the 12-digit key of the address; rewriting the same rows
    writes the same keys.  The columns stay in the objects too."""
    out = docs.select("*", F.col("actor").alias("raw_actor"), F.col("context").alias("raw_context"), key12(F.col("url")).alias("key"))
    out.repartition("key").write.mode("overwrite").partitionBy("raw_actor", "raw_context", "key").json(path)


def csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').option("quoteAll", True).csv(path)


def append_new(rows: DataFrame, path: str, key: str, fresh: bool = False) -> int:
    """Appends rows (of a key the least) whose key the table does not have; a repeated call with the same rows adds
    nothing.  Counted while writing, so the rows are computed once."""
    spark = rows.sparkSession
    rest = [c for c in rows.columns if c != key]
    one = rows.groupBy(key).agg(F.min(F.struct(*rest)).alias("_row")).select(key, "_row.*").select(*rows.columns) if rest else rows.distinct()
    create = fresh or not _exists(spark, path)
    if not create:
        one = one.join(spark.read.parquet(path).select(key), key, "left_anti")
    seen = Observation()
    one.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite" if create else "append").parquet(path)
    return seen.get["n"]


def dead_letters(labeled: DataFrame, path: str) -> None:
    labeled.where("error is not null").withColumn("failed_at", F.current_timestamp()).write.mode("append").parquet(path)


def load_table(df: DataFrame, name: str, spec: str = S.CORPUS, path: str | None = None) -> int:
    """Schema-checked bulk load with upper-case column names, to ``path`` where one is named; returns the rows loaded."""
    out = S.validate(df, spec)
    writer = out.toDF(*[c.upper() for c in out.columns]).write.mode("overwrite").format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return df.sparkSession.table(name).count()


def create_table(spark: SparkSession, name: str, spec: str = S.CORPUS, path: str | None = None) -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({spec}) USING parquet" + (f" LOCATION '{path}'" if path else ""))


def swap_column(spark: SparkSession, path: str, values: DataFrame, key: str, column: str) -> None:
    """Replaces a column of a written table: joined into a new version beside it, which then takes its place."""
    old = spark.read.parquet(path)
    new = old.drop(column).join(values.select(key, column), key, "left")
    mark = f"{path.rstrip('/')}-{uuid.uuid4().hex[:8]}"
    new.write.parquet(f"{mark}-new")
    fs = _fs(spark, path)
    # the old version is there until the new one stands in its place
    fs.rename(_path(spark, path), _path(spark, f"{mark}-old"))
    fs.rename(_path(spark, f"{mark}-new"), _path(spark, path))
    fs.delete(_path(spark, f"{mark}-old"), True)


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    return bool(_fs(spark, path).exists(_path(spark, path)))


def save_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """One small file through the file system of its path."""
    stream = _fs(spark, path).create(_path(spark, path), True)
    stream.write(bytearray(data))
    stream.close()
