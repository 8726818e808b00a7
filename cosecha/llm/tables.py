"""Tables that cut a plan: written once to the folder all executors share, then read."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Bytes of rows that reach Python at a time inside a ``scratch`` block; a longer row goes by itself.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Folders made here for sessions that name none (local tests), by application.
_own: dict[str, str] = {}
#: Paths of the tables written in each open ``scratch`` block of this thread or task, the innermost last.
_open: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        app = spark.sparkContext.applicationId
        folder = _own.setdefault(app, _own.get(app) or tempfile.mkdtemp(prefix="spark-"))
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: a lost executor costs no work done before it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cosecha/{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    if _open.get():
        _open.get()[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A block whose written tables go at its end, but for those that the given function writes.

    What is written inside passes to Python in batches of about ``BATCH_BYTES``, so that neither
    a worker nor its executor holds ten thousand whole texts; the session's own bound returns after it.
    """
    inner: list[str] = []
    outer = _open.get()
    bound = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(BATCH_BYTES))
    _open.set((*outer, inner))

    def keep(df: DataFrame, name: str) -> DataFrame:
        # The table belongs to the block around this one, if there is any.
        _open.set(outer)
        try:
            return written(df, name)
        finally:
            _open.set((*outer, inner))

    try:
        yield keep
    finally:
        _open.set(outer)
        spark.conf.set(_BATCH, bound)
        files = spark.sparkContext._jvm.org.apache.hadoop.fs
        for path in inner:
            place = files.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` (a written table) has at most ``rows`` rows, so that it may be broadcast."""
    return df.count() <= rows


def free_name(name: str, taken: Sequence[str]) -> str:
    """``name``, with as many underscores before it as keep it apart from ``taken``, whatever their case."""
    lowered = {t.lower() for t in taken}
    while name.lower() in lowered:
        name = f"_{name}"
    return name
