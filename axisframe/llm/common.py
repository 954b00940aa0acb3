"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch inside a task are walked in slices of about this many text bytes.
SLICE_BYTES = 4 << 20


#: What a Python worker keeps from one task to the next: at most one operator's compiled state.
_KEPT: dict[Hashable, Any] = {}


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """The state under ``key``, made on first use; another operator's state is given up for it."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Free what is kept. Called by name in tasks: a nested function would clear a copy of its own."""
    _KEPT.clear()


def release_buffers() -> None:
    """Hand Arrow's free buffers back at the end of a task; the Python worker lives on."""
    pa.default_memory_pool().release_unused()


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of a few megabytes for rows that hold whole texts; for applications to call."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: str = "text"):
    """A text column as UTF-8 bytes; a null text is empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def slices(batch: pa.RecordBatch, column: str | int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that ``column`` holds at most ``most`` bytes a slice, one row at least."""
    start = size = 0
    for i, value in enumerate(batch.column(column)):
        n = len(value.as_buffer()) if value.is_valid else 0
        if i > start and size + n > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def keep_rows(df: DataFrame, fn: Callable[[pa.Array], pa.Array], text: str, most: int = SLICE_BYTES
              ) -> DataFrame:
    """The rows of ``df`` for which ``fn``, given their texts as bytes, answers true; all columns stay.

    A null text is empty bytes to ``fn``. The text is handed over once, as it stands in the row.
    """
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for piece in slices(batch, place, most):
                body = pc.fill_null(piece.column(place).cast(pa.binary()), b"")
                yield piece.filter(fn(body))
        release_buffers()

    return df.mapInArrow(run, df.schema)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str,
              by: str | None = None, most: int = SLICE_BYTES, keeps: bool = False) -> DataFrame:
    """Apply ``fn`` batch by batch in the tasks; ``by`` names a bytes column that bounds a slice.

    ``keeps`` says that ``fn`` works with ``kept`` state; else what an earlier operator kept is freed.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            forget()
        for batch in batches:
            for part in slices(batch, by, most) if by else (batch,):
                if part.num_rows:
                    yield fn(part)
        release_buffers()
    return df.mapInArrow(run, schema)
