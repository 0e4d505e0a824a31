"""Session settings and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


_LOCAL_ROOTS: dict[str, str] = {}  # local mode without a named folder
_TABLES: dict[str, list[str]] = {}  # tables and folders that a session has made
_FOLDERS: dict[str, list[str]] = {}
BUCKET_BYTES = 8 << 20  # source bytes behind one bucket: answers take 10 to 20 bytes there and far more in a task


def build_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and the benchmark."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("learnloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def use_utc(spark: SparkSession) -> SparkSession:
    """Dates of the model are UTC dates."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="learnloom-")
    return _LOCAL_ROOTS[app]


def bucket_count(spark: SparkSession, source_bytes: int) -> int:
    """Buckets that hold about BUCKET_BYTES of source each, at least the shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-source_bytes // BUCKET_BYTES))


def hash_spread(df: DataFrame, keys: list[str], n: int | None = None) -> DataFrame:
    """Hash partition into ``n`` (else the shuffle) partitions, never merged by size."""
    return df.repartition(n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def note_folder(spark: SparkSession, path: str) -> str:
    """Remember a folder of intermediate data for ``cleanup``."""
    _FOLDERS.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialise(
    df: DataFrame, bucket_by: list[str] | None = None, partitioned: bool = False, buckets: int | None = None
) -> DataFrame:
    """Write ``df`` as Parquet in the checkpoint folder and read it back.

    Cuts lineage, survives executor loss and keeps column pruning, push-down and real
    table sizes for the optimizer. With ``bucket_by`` the table is hash-bucketed, so
    windows and aggregates on those keys (or on more keys) need no shuffle. ``partitioned``
    says that ``df`` already comes from ``hash_spread`` on them, into ``buckets`` partitions.
    """
    spark = df.sparkSession
    name = f"learnloom_{uuid.uuid4().hex}"
    path = note_folder(spark, f"{checkpoint_root(spark).rstrip('/')}/learnloom/{name}")
    if bucket_by is None:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(name)
    (
        (df if partitioned else hash_spread(df, bucket_by, buckets))
        .write.bucketBy(buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), *bucket_by)
        .sortBy(*bucket_by)
        .option("path", path)
        .format("parquet")
        .saveAsTable(name)
    )
    return spark.table(name)


def cleanup(spark: SparkSession) -> None:
    """Delete all intermediate tables and folders that this session has made.

    Results that still read them must be written first.
    """
    app = spark.sparkContext.applicationId
    for name in _TABLES.pop(app, []):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    for path in _FOLDERS.pop(app, []):
        delete_path(spark, path)


class Scratch:
    """Intermediate tables of one job in the folder all executors share.

    ``save`` writes a table and reads it back (cuts lineage, survives a lost executor);
    ``drop`` deletes one that is no longer read and ``close`` (or leaving a ``with`` block)
    the rest. A lazy result that still reads a table must be written before ``close``.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = note_folder(spark, f"{checkpoint_root(spark).rstrip('/')}/learnloom/job_{uuid.uuid4().hex}")
        self._paths: dict[int, str] = {}
        self._count = 0

    def path(self) -> str:
        self._count += 1
        return f"{self.root}/{self._count:04d}"

    def save(self, df: DataFrame) -> DataFrame:
        path = self.path()
        df.write.option("compression", "zstd").parquet(path)
        saved = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(saved)] = path
        saved._scratch_owner = self  # the id stays taken as long as the frame lives
        return saved

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            path = self._paths.pop(id(frame), None)
            if path:
                delete_path(self.spark, path)

    def close(self) -> None:
        self._paths.clear()
        delete_path(self.spark, self.root)

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *_) -> None:
        self.close()


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's own file system layer (any store Spark can write)."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


BROADCAST_ROWS = 10_000


def broadcast_checked(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only after counting that ``df`` is small; otherwise the optimizer and
    the runtime (size threshold, skew split) choose the join."""
    small = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if small else df
