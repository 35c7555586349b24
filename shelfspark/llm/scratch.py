"""Tables written to the shared folder, so that a lost executor never costs more than its own tasks."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.session import scratch_path

_ROOM: ContextVar[str | None] = ContextVar("room", default=None)


@contextmanager
def room(spark: SparkSession) -> Iterator[None]:
    """What :func:`written` writes inside is removed at the end; nothing that is read later may depend on it."""
    path = scratch_path(spark, "room")
    token = _ROOM.set(path)
    try:
        yield
    finally:
        _ROOM.reset(token)
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def rows_per_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs started inside pass at most ``rows`` rows at once between Spark and Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, name: str, stays: bool = False) -> DataFrame:
    """Write ``df`` as Parquet below ``spark.checkpoint.dir`` and read it back.

    Cuts lineage like a checkpoint. The reread table has no known partitioning, so joins on it
    exchange both sides anew and adaptive execution may split a hot key. Inside a :func:`room` the table goes
    with the room, unless it ``stays``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if _ROOM.get() and not stays:
        path = f"{_ROOM.get()}/{path.rsplit('/', 1)[1]}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sample_share(n_rows: int, bound: int) -> float:
    """Share of rows that keeps a sample within ``bound`` rows."""
    return 1.0 if n_rows <= bound else bound / n_rows


def beside(df: DataFrame, **columns: Column) -> DataFrame:
    """All columns of ``df`` as one struct ``row`` beside ``columns``, so that no name can clash; undo with ``row.*``."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.select(row.alias("row"), *[c.alias(name) for name, c in columns.items()])
