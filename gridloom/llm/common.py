"""Helpers shared by the corpus operators: scratch tables, tokenizer files, word rules."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from gridloom.session import discard, scratch_path, shared_dir, written  # noqa: F401

#: A word is a run of anything but these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows handed to Python in one Arrow batch; documents are a few KB, so a batch stays at a few MB.
BATCH_ROWS = 1000

#: Bytes at which a batch ends before it has as many rows: long texts then travel a few at a time.
BATCH_BYTES = 4 << 20
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Keep Arrow batches small, so that long texts cannot fill a Python worker or the buffers of an executor."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows or int(spark.conf.get(key, "10000")) <= 0:
        spark.conf.set(key, str(rows))
    now = spark.conf.get(_BYTES).rstrip("bB")
    if now.isdigit() and not 0 < int(now) <= size:  # with another unit it was set on purpose
        spark.conf.set(_BYTES, str(size))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_bucket(col: str, n: int):
    """crc32 of the id written as text, modulo n."""
    return F.crc32(F.col(col).cast("string")) % F.lit(n)


def row_ids(start: int = 0) -> Iterator[int]:
    """Ids that are unique over the tasks of a stage: partition number, then a counter."""
    from pyspark import TaskContext

    ctx = TaskContext.get()
    base = (ctx.partitionId() if ctx else 0) << 33
    n = start
    while True:
        yield base + n
        n += 1


def tokenizer_path(name: str) -> str:
    """A vocabulary file by name (of the installed public_tokenizers) or by absolute path."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=4)
def load_tokenizer(name: str):
    """The library's tokenizer, one per worker process, without truncation or padding."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path(name))
    tok.no_truncation()
    tok.no_padding()
    return tok


def free_name(df: DataFrame, name: str) -> str:
    """The name, or it with a number, such that df has no column of it."""
    taken, out, n = {c.lower() for c in df.columns}, name, 0
    while out.lower() in taken:
        n += 1
        out = f"{name}_{n}"
    return out


def same_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns by name, whatever the names hold."""
    return df.select(*("`" + c.replace("`", "``") + "`" for c in columns))


def with_columns_of(docs: DataFrame, run: Callable, fields: list[StructField]) -> DataFrame:
    """docs with further columns: ``run(place of text)`` gives a function for mapInArrow that adds arrays to each batch.

    Columns of docs travel under numbers, so their names may hold anything, and those of the further
    columns replace them."""
    names = {f.name.lower() for f in fields}
    kept = same_columns(docs, [c for c in docs.columns if c.lower() not in names])
    numbered = kept.toDF(*(f"c{i}" for i in range(len(kept.columns))))
    more = [StructField(f"more{i}", f.dataType) for i, f in enumerate(fields)]
    out = numbered.mapInArrow(run(kept.columns.index("text")), StructType([*numbered.schema.fields, *more]))
    return out.toDF(*kept.columns, *(f.name for f in fields))


def with_arrays(batch: pa.RecordBatch, *arrays: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, *(f"more{i}" for i in range(len(arrays)))])
