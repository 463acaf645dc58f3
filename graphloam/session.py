"""Session helpers: test session, shared folder, written tables that cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "graphloam") -> SparkSession:
    """A single-JVM session for tests and benches."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    Where the setting is absent a local session gets a folder of its own; on a
    cluster its absence is an error, since a machine-local folder would lose data.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master.startswith("local[") or master == "local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="graphloam-")
        spark.conf.set("spark.checkpoint.dir", found)
    spark.sparkContext.setCheckpointDir(found) if spark.sparkContext.getCheckpointDir() is None else None
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/graphloam/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here.

    The files outlive any executor, so a lost one costs only its running tasks.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`write_table`."""
    spark = df.sparkSession
    for f in {p.rpartition("/")[0] for p in df.inputFiles()}:
        if "/graphloam/" in f:
            path = spark._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def write_small(df: DataFrame, name: str, most: int = 200_000) -> DataFrame:
    """:func:`write_table`, and to be broadcast where it has few rows: otherwise joins with it would shuffle the other side before its size is known."""
    return _hinted(write_table(df, name), most)


def _hinted(table: DataFrame, most: int = 200_000) -> DataFrame:
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


_BITS = 1 << 26


def _place(keys: list[str]):
    return F.pmod(F.xxhash64(*keys), F.lit(_BITS))


def _bitmap(right: DataFrame, keys: list[str]) -> DataFrame:
    """(word_, bits_): the bits of the hashed keys of ``right``, at most a million words; with very many keys all are set and it spares nothing."""
    at = right.select(_place(keys).alias("at"))
    return F.broadcast(at.groupBy((F.col("at") / 64).cast("long").alias("word_")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits_")))


def _hit(keys: list[str]):
    return (F.col("word_") == (_place(keys) / 64).cast("long")) & (F.expr(f"shiftright(bits_, cast(pmod(xxhash64({', '.join(keys)}), {_BITS}L) % 64 as int)) & 1L") == 1)


def meeting(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The left semi join with a written table: a small one is broadcast, else rows of ``left`` are shuffled only where a bitmap of the keys lets them through."""
    right, all_right = _hinted(right), right
    if right is not all_right:
        return left.join(right, keys, "left_semi")
    return left.join(_bitmap(right, keys), _hit(keys), "left_semi").join(right, keys, "left_semi")


def missing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The left anti join likewise: what the bitmap has not is kept where it is."""
    right, all_right = _hinted(right), right
    if right is not all_right:
        return left.join(right, keys, "left_anti")
    bits = _bitmap(right, keys)
    return left.join(bits, _hit(keys), "left_anti").unionByName(left.join(bits, _hit(keys), "left_semi").join(right, keys, "left_anti"))


def local_table(spark: SparkSession, rows: list[tuple], **types: pa.DataType) -> DataFrame:
    """A small table of the driver's, part of the plan; made of a list, it would take Python workers of its own in every executor."""
    return spark.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(types), types.values())], list(types)))


def fresh_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that clash with no column of ``df``, in any case."""
    used = {c.lower() for c in df.columns}
    out = []
    for w in wanted:
        name = w
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers that don't have its folder on their path, and keep their Arrow batches small."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(8 << 20))
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or spark.conf.get("graphloam.shipped", None):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="graphloam-code-"), "graphloam.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, files in os.walk(package):
            for f in files:
                if f.endswith(".py"):
                    z.write(os.path.join(folder, f), os.path.relpath(os.path.join(folder, f), root))
    spark.sparkContext.addPyFile(archive)
    spark.conf.set("graphloam.shipped", "true")
