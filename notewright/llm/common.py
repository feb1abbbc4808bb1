"""What the operators share: inputs, shared folders, bounded samples, Arrow helpers."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.storage import Tables, shared_dir, small_batches

__all__ = ["Tables", "shared_dir", "small_batches"]

#: Fixed by the query contracts: a word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes that pass through a worker before it looks for memory to give back.
LITTLE = 4 << 20
_held: dict[object, object] = {}
_passed = 0


def held(key: object, make: Callable[[], object]) -> object:
    """What a Python worker keeps between tasks: one thing at a time, so that an operator's tables go
    when the next operator's tasks come."""
    if key not in _held:
        if _held:
            _held.clear()
            _give_back()
        _held[key] = make()
    return _held[key]


def _give_back() -> None:
    """Returns freed memory to the machine, where the C library can: workers outlive operators."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


# Functions of the module, since what a closure sets is a task's own.
def _count(n: int) -> None:
    global _passed
    _passed += n


def _much() -> bool:
    global _passed
    much = _passed >= LITTLE
    _passed *= not much
    return much


def lean(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker keeps no memory but what is in use; where little passed since it
    gave back last, there is nothing to search for."""

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _count(batch.nbytes)
            yield batch

    def ran(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(counted(batches))
        if _much():
            _give_back()

    return ran


def frugal(fit: Callable) -> Callable:
    """``fit``, after which the driver keeps no memory but the model: the texts learned from are gone."""

    @functools.wraps(fit)
    def ran(*args, **named):
        model = fit(*args, **named)
        _give_back()
        return model

    return ran


def crc_of(col: Column) -> Column:
    """CRC-32 of an id's decimal text, as the folds of the contracts use it."""
    return F.crc32(col.cast("string"))


def dice(*cols: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the given values alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 30)) / float(1 << 30)


def bounded_sample(rows: DataFrame, label: str, key: str, most: int, seed: int) -> DataFrame:
    """About ``most`` rows of each value of ``label``, all of them where there are fewer.

    A classifier may be fitted on such a sample; ``most`` is its documented bound.  The choice
    depends on the key alone, so reruns agree, and nothing is sorted or collected: one count for
    each label (a handful of rows) gives the share that is kept.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    if not counts:
        return rows.limit(0)
    keep = F.lit(0.0)
    for value, n in sorted(counts.items(), key=str):
        keep = F.when(F.col(label).eqNullSafe(F.lit(value)), min(1.0, most / max(n, 1))).otherwise(keep)
    return rows.where(dice(F.col(key), seed=seed) < keep)


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Python strings of an Arrow column, null as the empty text."""
    return [t or "" for t in column.to_pylist()]


def by_batch(fn: Callable[[pa.RecordBatch], dict[str, object]], schema: pa.Schema) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A ``mapInArrow`` function from one that gives the columns for each batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = fn(batch)
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array | pa.ChunkedArray) else columns[f.name] for f in schema], schema=schema)

    return lean(run)


def filtered(docs: DataFrame, text: str, keep: Callable[[list[str]], object]) -> DataFrame:
    """The rows of ``docs`` whose text ``keep`` approves, with all their columns; ``keep`` gets a batch
    of texts (null as empty) and returns a mask."""
    at = docs.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(keep(texts_of(batch.column(at))), pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
