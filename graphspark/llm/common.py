"""What the text operators share: bounded Arrow batches and small column rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphspark.session import find_package

#: Rows of one Arrow batch; with whole texts this bounds a Python worker's memory.
BATCH_ROWS = 1024


def bounded_batches(spark: SparkSession) -> None:
    find_package(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def map_rows(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str, arrow: pa.Schema) -> DataFrame:
    """mapInArrow over plain Python columns: `fn` gets the columns of one batch as lists and returns those of `arrow`."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch.to_pydict())
            yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return df.mapInArrow(run, schema)


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))
