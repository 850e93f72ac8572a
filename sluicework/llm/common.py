"""Helpers that the operators of this package share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import ship

#: Rows of an Arrow batch; texts of a few MB still fit a worker's memory.
BATCH_ROWS = 500
#: Bytes after which a Python stage hands on what it has made.
FLUSH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """What Python stages need: the package on the executors, and Arrow batches of bounded size."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table; Spark's reader alone opens the path."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def checkpoint_dir(spark: SparkSession) -> None:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only where none is set and all runs in one process, as in tests."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or f"{tempfile.gettempdir()}/sluicework-checkpoints")


def checkpoint(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint."""
    prepare(df.sparkSession)
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) only, so that extra columns can't clash; a null text is empty."""
    prepare(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A row's 64-bit key: rows with one id and text have one key, and others differ (but for a chance of about n squared / 2**65)."""
    return F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit("")))


def emit(rows: Iterable[tuple], schema: pa.Schema, weigh=None, flush: int = FLUSH_BYTES, most: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded size; weigh(row) is a row's bytes."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += weigh(row) if weigh else 64
        if size >= flush or len(held) >= most:
            yield to_batch(held, schema)
            held, size = [], 0
    if held:
        yield to_batch(held, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def tidy() -> None:
    """Gives memory that Python and Arrow no longer use back to the system: workers live on from stage to stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def drop_tables() -> None:
    """Forgets what `kept` holds, in a stage that needs none of it."""
    _HELD.clear()
    tidy()


def sliced(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a column's texts have at most so many bytes together, or are one row."""
    import pyarrow.compute as pc

    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_pylist()
        begin = held = 0
        for i, n in enumerate(size):
            if held and held + n > most:
                yield b.slice(begin, i - begin)
                begin, held = i, 0
            held += n
        if begin < b.num_rows:
            yield b.slice(begin)


_HELD: dict = {}


def kept(key, make):
    """make() once for a worker, until another key is asked for: a worker holds one operator's tables at a time."""
    if key not in _HELD:
        drop_tables()
        _HELD[key] = make()
    return _HELD[key]


def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """(doc_ids, texts) of each batch of a few MB."""
    for b in sliced(batches, most=2 << 20):
        yield b.column("doc_id").to_pylist(), b.column("text").to_pylist()
