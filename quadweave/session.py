"""Session helpers: builder for tests and benches, and tables in the shared folder."""

from __future__ import annotations

import contextlib
import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "quadweave", **conf: str) -> SparkSession:
    """A session for tests, benches and the command line; clusters bring their own."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    A temporary folder is used only where the setting is absent in a local session (tests, benches):
    on a cluster each machine would have one of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = "file://" + tempfile.mkdtemp(prefix="quadweave-")
    return _local_dirs[app]


class Table:
    """A DataFrame written to the shared folder; drop() deletes its files."""

    def __init__(self, df: DataFrame):
        spark = df.sparkSession
        self._spark = spark
        self.path = f"{shared_dir(spark)}/quadweave/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        with contextlib.suppress(Exception):
            jvm = self._spark._jvm
            path = jvm.org.apache.hadoop.fs.Path(self.path)
            path.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a table that may be broadcast because its files are small.
MOST_BROADCAST = 100_000


def held_if_small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df as a side of a join that Spark may broadcast only if it has few rows: compressed files tell little of what the driver would hold."""
    if rows is None:
        rows = df.limit(MOST_BROADCAST + 1).count()
    return df if rows <= MOST_BROADCAST else df.hint("merge")


#: Bytes of a source's files for each partition of a dealt table: what is made of them fits a task's memory.
DEALT_BYTES = 4 << 20


def dealt(df: DataFrame, source: DataFrame, *columns: str) -> DataFrame:
    """df, a few narrow columns of source, dealt by columns over partitions in proportion to the size of source.

    Rows that are made of it afterwards stay where they are, as long as steps are keyed by these columns.
    Their number is fixed here, since adaptive execution would choose it by the size of the narrow rows.
    """
    size = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(size / DEALT_BYTES))
    return df.repartition(min(parts, 100_000), *columns)
