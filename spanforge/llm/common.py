"""What the operators on training text share."""

from __future__ import annotations

import contextlib
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .tokens import forget

#: Rows that are handled together in Python, whatever the size of the Arrow batch.
ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextlib.contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """What runs within sends at most ROWS rows or 4 MB at once to Python, for whose batches an executor needs several times their size."""
    short = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}
    before = {k: spark.conf.get(k, None) for k in short}
    for k, v in short.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def row_key() -> Column:
    """A key of a row of doc_id and text; rows without a doc_id have one for each text."""
    return F.xxhash64("doc_id", "text")


def column_of(each: Callable[[list], list], kind: str, out: pa.DataType) -> Callable[..., Column]:
    """A column function: ``each`` makes of up to ROWS values as many of the Spark type ``kind``, in a worker that forgets tokens."""

    @F.arrow_udf(kind)
    def run(values: pa.Array) -> pa.Array:
        forget()
        gc.disable()
        parts = []
        for at in range(0, len(values), ROWS):
            parts.append(pa.array(each(values.slice(at, ROWS).to_pylist()), out))
        gc.collect(0)
        gc.enable()
        pa.default_memory_pool().release_unused()
        return pa.concat_arrays(parts) if parts else pa.array([], out)

    return run


def map_rows(df: DataFrame, make: Callable[[], Callable[[list], dict[str, list]]], schema: StructType, tokenizes: bool = False) -> DataFrame:
    """``mapInArrow`` over lists of column values.

    ``make()`` runs once in each task and returns a function from the columns
    of up to ROWS rows (as lists) to the columns of any number of output rows.
    Workers live on from task to task; what earlier tasks
    remembered of their tokens is let go unless the operator tokenizes.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not tokenizes:
            forget()
        each = make()
        gc.disable()  # the many lists of words hold no cycles; what else might is collected batch by batch
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                got = each([c.to_pylist() for c in batch.slice(at, ROWS).columns])
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in out], schema=out)
            gc.collect(0)
        gc.enable()
        pa.default_memory_pool().release_unused()  # the worker lives on

    return df.mapInArrow(run, schema)
