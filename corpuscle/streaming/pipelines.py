"""Structured Streaming: windowed event counts, late data, de-duplication and resumable labelling."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.labeling import LexiconLabeler, label, one_hot
from ..session import shared_folder
from ..sources.sinks import _exists


def read_parquet_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Parquet files as a stream; a single file is read through its folder and a name filter."""
    folder, _, name = path.rstrip("/").rpartition("/")
    if name.endswith(".parquet") and not _is_folder(spark, path):
        return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return spark.readStream.schema(schema).parquet(path)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory())


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Tumbling counts and sums per event type, rows later than ``late`` dropped by the watermark."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions per user: start, end and events."""
    g = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap))
    return g.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def drain(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there and returns its result, written to the shared folder batch by batch."""
    spark = stream.sparkSession
    out = shared_folder(spark, "drained")
    save = "overwrite" if mode == "complete" else "append"
    q = stream.writeStream.outputMode(mode).foreachBatch(lambda batch, _: batch.write.mode(save).parquet(f"{out}/rows")).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows") if _exists(spark, f"{out}/rows") else spark.createDataFrame([], stream.schema)


def label_stream(sentences: DataFrame, out: str, factory=LexiconLabeler, checkpoint: str | None = None) -> None:
    """Labels micro-batches, each id once: the ids seen are kept in the stream's state, and a batch that is repeated
    after a failure replaces its own folder.  A restarted run continues where it stopped; its state lies beside the
    output unless another folder is named."""

    def write(batch: DataFrame, epoch: int) -> None:
        one_hot(label(batch, factory)).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    once = sentences.dropDuplicates(["sentence_id"])
    once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint or f"{out.rstrip('/')}-state").trigger(availableNow=True).start().awaitTermination()


def unique_urls(stream: DataFrame, ts: str = "ts", late: str = "1 day") -> DataFrame:
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(["url"])
