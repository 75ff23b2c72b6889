"""What the operators share: tables, Arrow row mapping, fixed patterns."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: White space between words; every operator that counts words uses it.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_of_id(column: str = "doc_id"):
    """Unsigned CRC32 of an id's decimal text; a null id counts as empty text (0)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))


def parts(batch: pa.RecordBatch, size: int, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most size rows and about most_bytes; only a single row may be larger."""
    at = 0
    while at < batch.num_rows:
        n = min(size, batch.num_rows - at)
        while n > 1 and batch.slice(at, n).nbytes > most_bytes:
            n //= 2
        yield batch.slice(at, n)
        at += n


#: What this worker keeps for its next tasks, such as a tokenizer.
_kept: dict = {}


def kept(key, make: Callable):
    """make(), made once in a worker; the next tasks that name the key in `worker_task` find it there."""
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def let_go(key=None) -> None:
    """Drops what the worker keeps under other keys, and gives freed memory back to the system.

    Spark's workers outlive their tasks, and the allocator holds on to what was freed, so an executor would carry both through
    all later steps."""
    for other in [k for k in _kept if k != key]:
        del _kept[other]
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def worker_task(run: Callable, key=None) -> Callable:
    """run, for mapInArrow, as a task that needs what the worker keeps under key and nothing else that it keeps."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(key)
        try:
            yield from run(batches)
        finally:
            let_go(key)

    return task


def map_rows(df: DataFrame, columns: list[str], fn: Callable[..., dict[str, list]], schema: StructType, size: int = 256, text_bytes: int = 4 << 20, key=None) -> DataFrame:
    """fn(**lists of the named columns) -> dict of lists, over slices of at most size rows and about text_bytes of data.

    A slice never holds more than one row beyond text_bytes, so memory follows the longest row. key: of what the worker keeps
    for fn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(schema)
        for batch in batches:
            for part in parts(batch, size, text_bytes):
                got = fn(*(part.column(i).to_pylist() for i in range(part.num_columns)))
                if got is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in out], schema=out)

    return df.select(*columns).mapInArrow(worker_task(run, key), schema)
