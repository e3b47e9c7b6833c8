"""What the operators of this subpackage share: intermediate tables and row mappers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or a local one where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
    return (found or os.path.join(tempfile.gettempdir(), "checkpoints")).rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: cuts the lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_batch(df: DataFrame, schema: str, function: Callable[[pa.RecordBatch], Iterator[dict]]) -> DataFrame:
    """mapInArrow with a function from one batch to column dictionaries."""

    def run(batches):
        target = None
        for batch in batches:
            if batch.num_rows:
                for columns in function(batch):
                    arrays = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for x in columns.values()]
                    if target is None:
                        target = pa.schema([(k, a.type) for k, a in zip(columns, arrays, strict=True)])
                    yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return df.mapInArrow(run, schema)


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts
