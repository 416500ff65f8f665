"""Intermediate tables: lineage is cut by writing Parquet to the folder all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: str | None = None
_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Where it is unset a session of this machine alone (``local[...]``, tests)
    gets a temporary folder; a cluster has no folder of its own to share, so
    there it is an error.
    """
    global _own
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="folioforge-")
    return f"file://{_own}"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone already
        pass


def scratch(spark: SparkSession) -> str:
    """A fresh place in the shared folder, removed by :func:`discard`, :func:`release_all` or when the Python process ends."""
    path = f"{shared_dir(spark)}/folioforge/{uuid.uuid4().hex}"
    if not _written:
        atexit.register(release_all)
    _written[path] = spark
    return path


def discard(path: str | None) -> None:
    """Remove a place of :func:`scratch` at once; other paths are left alone."""
    if path in _written:
        _remove(_written.pop(path), path)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once and read it back.

    The written table survives the loss of executors, is computed once however
    often it is used, and starts a fresh lineage.  It is removed by
    :func:`release`, :func:`release_all` or when the Python process ends.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def release(df: DataFrame) -> None:
    """Remove a table of :func:`materialize` that nothing reads any more; other frames are left alone."""
    discard(getattr(df, "_written_path", None))


def release_all() -> None:
    """Remove every table of :func:`materialize` (results that read them must have been written)."""
    while _written:
        path, spark = _written.popitem()
        _remove(spark, path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on whatever file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def rows_at_most(df: DataFrame, bound: int) -> bool:
    """Whether ``df`` has at most ``bound`` rows; reads no more than ``bound + 1``."""
    return df.limit(bound + 1).count() <= bound


def pick(df: DataFrame, **names: str) -> DataFrame:
    """Columns of ``df`` under new names, found by exact name and place; ``id`` as a long.

    Whatever else the table holds, also names that differ only in case or clash
    with names used inside, does not matter.
    """
    places = {c: i for i, c in reversed(list(enumerate(df.columns)))}
    missing = [n for n in names.values() if n not in places]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} among {df.columns}")
    plain = df.toDF(*(f"_{i}" for i in range(len(df.columns))))
    return plain.select(*(F.col(f"_{places[old]}").cast("long").alias(new) if new == "id" else F.col(f"_{places[old]}").alias(new) for new, old in names.items()))


_PLAIN = ("Project", "Filter", "Relation", "LogicalRelation", "SubqueryAlias")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where a plain scan has fewer splits than the cluster has cores.

    Small or single-row-group files come as one split; work on whole texts would
    then run on one core.  A scan with enough splits is left as it is, so large
    inputs are never shuffled for this; plans with joins or aggregates are left too.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    try:
        run = df._jdf.queryExecution()
        steps = [line.lstrip(" :+-") for line in run.optimizedPlan().toString().splitlines() if line.strip()]
        if df.isStreaming or not all(x.startswith(_PLAIN) for x in steps):
            return df
        splits = run.toRdd().getNumPartitions()
    except Exception:  # noqa: BLE001  other kinds of sessions have no such handle
        return df
    return df.repartition(cores) if splits < cores else df
