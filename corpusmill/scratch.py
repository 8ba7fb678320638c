"""Tables that cut a plan's lineage.

They live under the folder that the cluster names in ``spark.checkpoint.dir``, which the driver
and all executors share. An executor that is lost takes none of them with it, because they are
ordinary Parquet (or ORC) tables that Spark's committer published.
"""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_lock = threading.Lock()
_writing: dict[str, tuple[int, str]] = {}  # by application: tables being written, and the setting before them


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of this application, as a URI without a trailing slash.

    A local session that names no ``spark.checkpoint.dir`` (tests) gets a temporary folder, set once. A cluster must name one:
    tables in a folder of one machine would be lost to all others.
    """
    root = spark.conf.get(_SETTING, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{_SETTING} must name a folder that the driver and all executors share")
        root = getattr(scratch_root, "local", None)
        if root is None:
            root = scratch_root.local = "file://" + tempfile.mkdtemp(prefix="corpusmill-")
    return f"{root.rstrip('/')}/corpusmill/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under :func:`scratch_root` that nothing else uses."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def clear(spark: SparkSession) -> None:
    """Deletes all tables that this application stored; results that still read them can't be computed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder, and read again.

    Once the table is stored, nothing reads the shuffles that made it: their files go at once, not when
    the driver happens to collect its garbage. The setting for this holds while any table is being written.
    """
    spark = df.sparkSession
    path, app = scratch_path(spark, name), spark.sparkContext.applicationId
    with _lock:
        n, before = _writing.get(app, (0, spark.conf.get(_CLEAN_UP, "false")))
        _writing[app] = n + 1, before
        spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        with _lock:
            n, before = _writing.pop(app)
            if n > 1:
                _writing[app] = n - 1, before
            else:
                spark.conf.set(_CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


#: A table of fewer bytes a core may lie in a few row groups, and is dealt to all cores; a larger one has row groups enough.
SPREAD_BYTES = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """A table's rows over all cores, where it is small and lies in fewer files than there are cores; any other as it is.

    A row group is one task's work, however many cores wait. What is dealt anew is bounded by ``SPREAD_BYTES`` a core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > cores * SPREAD_BYTES or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores)


def _is_parquet_scan(df: DataFrame) -> bool:
    """Whether rows come straight from Parquet files, at most filtered and projected."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation" and "parquet" in plan.toString()


def numbered(df: DataFrame, key: str) -> DataFrame:
    """``df`` with a column ``key`` of two longs that tells its rows apart, the same whenever and wherever a row is read.

    A row's key is its file, by a 64-bit hash of the path, and its place there. Unlike a number given while a plan runs, it depends neither
    on how files are cut into tasks nor on the order in which a shuffle delivers. What doesn't come straight from Parquet files is stored first.
    """
    if not _is_parquet_scan(df):
        df = materialize(df, "numbered")
    return df.select("*", F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias(key))
