"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import pickle
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOCAL_DEFAULT = "file:///tmp/checkpoints/geoloom"
_MADE: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where that is unset, a local default on a local master (tests), an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (folder or LOCAL_DEFAULT).rstrip("/")


def share(spark: SparkSession, model):
    """A broadcast of ``model`` for :func:`shared`, pickled with its class: workers need not be able to import this package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(model))


def shared(broadcast):
    """The model of a :func:`share` on a worker."""
    return pickle.loads(broadcast.value)


def application_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one."""
    return f"{shared_dir(spark)}/geoloom-{spark.sparkContext.applicationId}"


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's folder, which goes when the application ends."""
    root = application_dir(spark)
    if root not in _MADE:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _MADE.add(root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear_stages(spark: SparkSession) -> None:
    """Delete all tables that this application has staged; results not yet computed or written can then no longer be read."""
    _delete(spark, application_dir(spark))


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*frames: DataFrame) -> None:
    """Delete tables that :func:`materialize` wrote, once nothing lazy reads them any more."""
    for df in frames:
        mark = f"/geoloom-{df.sparkSession.sparkContext.applicationId}/"
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if mark in folder:
                _delete(df.sparkSession, folder)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bounded_sample(rows: DataFrame, group: str, most: int) -> DataFrame:
    """At most ``most`` rows of each group, those with the least 63-bit hashes; all rows of a smaller group.

    A threshold on the hash, eight standard deviations above the share wanted, keeps all but about ``most`` rows of a
    group from the shuffle, and a rank makes the bound exact, however often a row is repeated.  Groups are few.
    """
    sizes = {r[0]: r[1] for r in rows.groupBy(group).agg(F.count(F.lit(1))).collect()}  # one row a group
    if not sizes:
        return rows
    hashed, top = F.shiftrightunsigned(F.xxhash64(*sorted(rows.columns)), 1), 1 << 63
    wanted = most + 8 * int(most**0.5) + 64
    limits = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(top - 1, top * wanted // n)).cast("long"))])
    near = rows.where(hashed <= limits[F.col(group)])
    order = Window.partitionBy(group).orderBy(hashed)
    return near.withColumn("__nth", F.row_number().over(order)).where(F.col("__nth") <= most).drop("__nth")
