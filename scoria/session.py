"""Session settings, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Keys with more than this part of all rows are hot in skew-aware joins; there can be at most 1/HOT_SHARE of them.
HOT_SHARE = 0.005


def local_session(cores: str = "8", app: str = "scoria", **conf: str) -> SparkSession:
    """A session for one machine, for tests and benchmarks; on a cluster the session comes from outside."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    spark = builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SHIPPED: set[str] = set()
_STAGING: dict[str, str] = {}


def ship_package(spark: SparkSession | None = None) -> None:
    """Sends this package's source to the workers, once per application, so that it need not be installed on them.

    Every operator that runs Python on workers calls it; without ``spark`` it is for the active session, if there is one.
    """
    spark = spark or SparkSession.getActiveSession()
    if spark is None or spark.sparkContext.applicationId in _SHIPPED:
        return
    _SHIPPED.add(spark.sparkContext.applicationId)
    root = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="scoria-source-")) / "scoria_source.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))


def shipped(df: DataFrame) -> DataFrame:
    """``df``, with this package on its session's workers."""
    ship_package(df.sparkSession)
    return df


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whatever file system it names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def is_folder(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def modified_at(spark: SparkSession, path: str) -> int | None:
    """When a file was last changed, in milliseconds; null if it isn't there. For a folder, its newest file's time."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(at):
        return None
    status = system.getFileStatus(at)
    if status.isFile():
        return status.getModificationTime()
    return max((f.getModificationTime() for f in system.listStatus(at)), default=status.getModificationTime())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below ``sf_dir``."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def staging_folder(spark: SparkSession) -> str:
    """The application's own folder below the cluster's shared one; it goes when the application's JVM ends.

    The shared folder is the session's ``spark.checkpoint.dir``, or what the context was given. Only on one machine, where
    neither is set, a temporary folder is taken: on a cluster each executor would write to a disk of its own.
    """
    context = spark.sparkContext
    if context.applicationId not in _STAGING:
        shared = context.getConf().get("spark.checkpoint.dir")
        given = context._jsc.sc().getCheckpointDir()
        if not shared and given.isDefined():
            shared = given.get()
        if not shared:
            if not context.master.startswith("local[") and context.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            shared = "file://" + tempfile.mkdtemp(prefix="scoria-")
        folder = f"{shared.rstrip('/')}/scoria-{context.applicationId}"
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
        _STAGING[context.applicationId] = folder
    return _STAGING[context.applicationId]


def release_staging(spark: SparkSession) -> None:
    """Deletes what cut_lineage wrote; DataFrames that were built on it can't be read any more."""
    context = spark.sparkContext
    folder = _STAGING.pop(context.applicationId, None)
    if folder:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the staging folder as parquet and goes on from there.

    The copy outlives the loss of executors, unlike a local checkpoint or a cache; it is read by column, and the optimiser
    knows its size. It is written when this is called.
    """
    spark = df.sparkSession
    where = f"{staging_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(where)
    return spark.read.schema(df.schema).parquet(where)


def skew_join(rows: DataFrame, dim: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Equi-join ``rows`` to ``dim`` (unique in ``key``) without sending all rows of a hot key to one task.

    ``dim[weight]`` is the number of rows that the key has, ``total`` that of all rows. The dim rows of keys holding more
    than HOT_SHARE of all rows - at most 1/HOT_SHARE of them, whatever the data's size - are broadcast, so the rows of hot
    keys are joined where they are read and not shuffled at all; the others meet by key. Both parts read ``rows``, which
    should be a table. Inner join on non-null keys; all columns of ``rows`` and of ``dim``, ``key`` once.
    """
    limit = total * HOT_SHARE
    hot = F.broadcast(dim.filter(F.col(weight) > limit))
    cold = rows.join(hot.select(key), key, "left_anti").join(dim.filter(F.col(weight) <= limit), key)
    return rows.join(hot, key).unionByName(cold)


def place_within(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Adds ``name``: 1, 2, 3 ... within ``keys`` (none: over all rows) in the total order ``order``, as row_number does, but with no key in one task.

    Rows are range-partitioned by keys and order, so a hot key takes as many partitions as its size asks for; each
    partition counts by itself and adds what the key has in the partitions before; only a partition's first key has any
    there, so these are no more rows than partitions. The partitioning is written down first, as counts and rows must see
    the same one.
    """
    spread = cut_lineage(df.repartitionByRange(*keys, *order).withColumn("__p", F.spark_partition_id()))
    local = spread.withColumn("__n", F.row_number().over(Window.partitionBy("__p", *keys).orderBy(*order)))
    # one row per key and partition that has it
    counts = spread.groupBy("__p", *keys).agg(F.count(F.lit(1)).alias("__c"))
    ahead = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("__p")
    counts = counts.select("__p", *keys, (F.sum("__c").over(ahead) - F.col("__c")).alias("__before")).filter("__before > 0")
    same = F.lit(True)
    for k in ["__p", *keys]:
        same = same & F.col(f"l.`{k}`").eqNullSafe(F.col(f"c.`{k}`"))
    place = (F.col("l.__n") + F.coalesce("c.__before", F.lit(0))).alias(name)
    return local.alias("l").join(F.broadcast(counts).alias("c"), same, "left").select(*(F.col(f"l.`{c}`") for c in df.columns), place)
