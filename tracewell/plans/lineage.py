"""Cutting lineage through tables written to the cluster's shared folder.

``spark.checkpoint.dir`` names the folder that every executor can read.  A table
written there survives the loss of any executor, and its readers get Parquet
statistics and column pruning that an RDD checkpoint would not give them.

Frames that operators return read such tables, so they stand until :func:`sweep` is
called by who has used up the frames, or until the process ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_PREFIX = "tracewell-"
#: Tables of this process that stand, with their sessions.
_STANDING: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only in plain local mode.

    On a cluster without that setting this raises: a folder of one machine would
    lose data with the machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix=_PREFIX)
    spark.sparkContext.setCheckpointDir(own)
    return own


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{_PREFIX}{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STANDING[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._tracewell_path = path
    return out


def drop_written(df: DataFrame) -> None:
    """Delete the table behind a frame of :func:`written` that nothing reads any more."""
    path = getattr(df, "_tracewell_path", None)
    if path:
        _delete(path, df.sparkSession)


def _delete(path: str, spark: SparkSession) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
    _STANDING.pop(path, None)


def standing() -> set[str]:
    """The tables that stand now, for a later :func:`sweep`."""
    return set(_STANDING)


def sweep(before: set[str] = frozenset(), keep: DataFrame | None = None) -> None:
    """Delete the tables written since ``before``, but for that of ``keep``. Frames that read them cannot be used any more."""
    for path, spark in list(_STANDING.items()):
        if path not in before and path != getattr(keep, "_tracewell_path", None):
            _delete(path, spark)


@atexit.register
def _at_the_end() -> None:
    try:
        sweep()
    except Exception:  # noqa: BLE001 - the session may be gone, and with it what could delete
        _STANDING.clear()


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names like ``wanted`` that no column of ``df`` has, in any letter case."""
    taken = {c.lower() for c in df.columns}
    names = []
    for want in wanted:
        name = want
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        names.append(name)
    return names
