"""Session construction, table access and lineage cutting shared by every operator."""
from __future__ import annotations

import math
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest dimension (rows) that an operator may broadcast after counting it.
MAX_BROADCAST_ROWS = 100_000
#: Bits of a membership test that is broadcast at most (16 MB).
MAX_TEST_BITS = 27


def build_session(master: str = "local[8]", app: str = "corpuscle", **conf: str) -> SparkSession:
    """A session with the settings the operators assume: UTC, AQE, Arrow transfer."""
    b = SparkSession.builder.master(master).appName(app)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; where that is unset, a temporary one on a single machine and an
    error on a cluster."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), f"corpuscle-checkpoints-{uuid.uuid4().hex[:8]}")
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:8]}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, limit: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast only when its counted size is within ``limit``; else leave the join to Catalyst."""
    n = df.limit(limit + 1).count()
    return F.broadcast(df) if n <= limit else df


def test_bits(keys: DataFrame, column, n: int) -> DataFrame:
    """(b, bits): a bit set of the 64-bit hashes ``column`` of the ``n`` ``keys``, at most ``2**MAX_TEST_BITS`` bits."""
    cell = F.shiftrightunsigned(column, 64 - _width(n))
    return keys.select(cell.alias("c")).groupBy(F.shiftright("c", 15).alias("b")).agg(F.bitmap_construct_agg(F.col("c").bitwiseAND(F.lit(32767))).alias("bits"))


def _width(n: int) -> int:
    return min(MAX_TEST_BITS, max(16, math.ceil(math.log2(16 * (n + 1)))))


def may_hold(df: DataFrame, column, bits: DataFrame, n: int, how: str = "left_semi") -> DataFrame:
    """Rows whose hash ``column`` may be (``left_semi``) or certainly is not (``left_anti``) among the ``n`` in ``bits``.
    The bits are at most 2 ** (MAX_TEST_BITS - 15) rows of 4 kB, so they are broadcast."""
    c = F.shiftrightunsigned(column, 64 - _width(n))
    at = F.substring(F.col("bits"), (F.shiftright(c.bitwiseAND(F.lit(32767)), 3) + 1).cast("int"), F.lit(1))
    bit = F.call_function("shiftright", F.conv(F.hex(at), 16, 10).cast("int"), c.bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1))
    return df.join(F.broadcast(bits), (F.shiftright(c, 15) == F.col("b")) & (bit == 1), how)


def settle(df: DataFrame, key: str, cases: DataFrame, keep) -> DataFrame:
    """Rows of ``df`` whose ``key`` is not among ``cases`` (one row a key, materialised), and of the others those for which
    ``keep``, on the columns of both, holds.  Few cases are broadcast; with many, only rows that may be a case (a bit
    set tells) are shuffled.  The other rows never move."""
    n = cases.count()
    if not n:
        return df
    marked = cases.withColumn("_case", F.lit(True))
    keep = F.col("_case").isNull() | keep
    extra = [c for c in marked.columns if c != key]
    if n <= MAX_BROADCAST_ROWS:
        return df.join(F.broadcast(marked), key, "left").where(keep).drop(*extra)
    h = lambda: F.xxhash64(F.col(key))
    bits = cut(test_bits(cases, h(), n))
    near = may_hold(df, h(), bits, n).join(marked, key, "left").where(keep).drop(*extra)
    return may_hold(df, h(), bits, n, "left_anti").unionByName(near.select(*df.columns))


def squash(c):
    """Comparison key for names: any run of Unicode blanks is one space, ends trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(c, r"(?U)[\s\x{200B}\x{FEFF}]+", " ")))


def spread(df: DataFrame) -> DataFrame:
    """Rebalance rows before heavy per-row work where the scan has fewer files than the cluster has cores
    (a Parquet file written as one row group is one task, however large); otherwise leave the scan as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    files = len(df._jdf.inputFiles())  # counted in the JVM
    return df.repartition(2 * cores) if 0 < files < cores else df


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, so that workers need no shared PYTHONPATH."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="corpuscle-"), "corpuscle.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)
