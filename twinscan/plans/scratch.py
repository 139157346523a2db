"""Where lineage is cut.

Iterative operators write intermediate tables to the shared folder the cluster names in
``spark.checkpoint.dir`` (all executors see it, so losing one costs nothing but a re-read). Only a
local session without that setting, such as a unit test, gets a folder of its own.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, SparkSession] = {}  # by path
_own: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="twinscan-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        root = _own[0]
    return root.rstrip("/")


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder once and read it back.

    Parquet rather than ``checkpoint()``: it is compressed, keeps column pruning for the readers, and
    the files can be removed as soon as the next table has been written (``release``).
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/twinscan-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made[path] = spark
    back = spark.read.schema(df.schema).parquet(path)
    back._twinscan_path = path
    return back


def release(df: DataFrame) -> None:
    """Remove a table made by ``cut`` that nothing reads any more."""
    path = getattr(df, "_twinscan_path", None)
    if _made.pop(path, None) is not None:
        _remove(df.sparkSession, path)


def release_all(spark: SparkSession, since: frozenset[str] = frozenset()) -> None:
    """Remove all tables of a session but those in ``since``, when no result that reads them is wanted any more.

    A query's result is lazy and reads its tables until it has been written, so only the caller knows when; a
    long session calls this after each result: ``before = written(spark)``, then ``release_all(spark, before)``.
    """
    for path in written(spark) - since:
        _made.pop(path, None)
        _remove(spark, path)


def written(spark: SparkSession) -> frozenset[str]:
    """Paths of the tables the session has written and not removed."""
    return frozenset(p for p, s in _made.items() if s is spark)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session may be gone; the folder is scratch anyway
        pass


@atexit.register
def _clean() -> None:
    for path, spark in _made.items():
        if spark.sparkContext._jsc is not None:
            _remove(spark, path)
