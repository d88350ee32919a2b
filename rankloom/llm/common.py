"""What the operators share: inputs, scratch tables and ways to write array results."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.session import cut_lineage

__all__ = ["cut_lineage", "documents", "lists", "map_batches", "rewrite_texts", "table"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string) of any table of texts; other columns, whatever their names, are
    left out, and a null text is an empty one."""
    return docs.select(
        docs[f"`{id_col}`"].cast("long").alias("doc_id"),
        F.coalesce(docs[f"`{text_col}`"].cast("string"), F.lit("")).alias("text"),
    )


def map_batches(
    df: DataFrame,
    step: Callable[[pa.RecordBatch], dict[str, Iterable] | Iterator[dict[str, Iterable]]],
    schema: str,
) -> DataFrame:
    """mapInArrow with a function from a record batch to columns (or to several lots of columns)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = step(batch)
            for columns in [made] if isinstance(made, dict) else made:
                arrays = [_array(columns[f.name], f.type) for f in fields]
                yield pa.RecordBatch.from_arrays(arrays, schema=fields)

    return df.mapInArrow(run, schema)


def _array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, (pa.Array, pa.ChunkedArray)):
        values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
        return values if values.type == kind else values.cast(kind)
    if isinstance(values, np.ndarray) and values.dtype == np.uint64:
        values = values.view(np.int64)
    return pa.array(values, type=kind)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column whose row i holds the next counts[i] values."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    if values.dtype == np.uint64:
        values = values.view(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, type=kind))




def rewrite_texts(
    docs: DataFrame,
    step: Callable[[pa.RecordBatch], Iterator[tuple[int, pa.Array, np.ndarray]]],
    text_col: str = "text",
    size_col: str = "n_chars",
) -> DataFrame:
    """The rows of `docs`, all columns, with new texts; no shuffle. `step` gets a batch of
    (doc_id, text), null texts empty, and yields for runs of rows: their number, their new texts and
    which of them stay. A column named by `size_col` gets the new length in code points."""
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = to_arrow_schema(docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(text_col).fill_null("")
            at = 0
            for n, texts, stays in step(pa.RecordBatch.from_arrays([batch.column("doc_id"), text], ["doc_id", "text"])):
                columns = []
                for i, field in enumerate(fields):
                    column = batch.column(i).slice(at, n)
                    if field.name == text_col:
                        column = _array(texts, field.type)
                    elif field.name == size_col and pa.types.is_integer(field.type):
                        column = pa.compute.utf8_length(texts).cast(field.type)
                    columns.append(column.filter(pa.array(stays, pa.bool_())))
                at += n
                yield pa.RecordBatch.from_arrays(columns, schema=fields)

    return docs.mapInArrow(run, docs.schema)
