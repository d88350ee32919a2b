"""Long ordered tables kept for paging: written once in order, read a page at a time.

The rows are dealt by range of their order, sorted, and written as one folder per range. A small table
says where each range starts, so a page, however far down, opens the folders it lies in and no other.
Pages go by number, or on from the place of the last row seen.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.session import scratch_path


@dataclass(frozen=True)
class Listing:
    rows: DataFrame  # with part and n, the place in it
    starts: dict[int, tuple[int, int]]  # part: rows before it, rows in it

    @property
    def total(self) -> int:
        return sum(n for _, n in self.starts.values())

    def page(self, number: int, size: int = 25) -> DataFrame:
        """Page `number` (from 0) in order, with `place` from 1."""
        return self.after(number * size, size)

    def after(self, place: int, size: int = 25) -> DataFrame:
        """The `size` rows that follow the row at `place`."""
        wanted = {p: start for p, (start, n) in self.starts.items() if start < place + size and start + n > place}
        before = F.lit(0).cast("long")
        for part, start in wanted.items():
            before = F.when(F.col("part") == part, F.lit(start).cast("long")).otherwise(before)
        return (
            self.rows.filter(F.col("part").isin(list(wanted)))
            .withColumn("place", before + F.col("n") + 1)
            .filter((F.col("place") > place) & (F.col("place") <= place + size))
            .drop("part", "n")
            .orderBy("place")
        )


def write_listing(rows: DataFrame, order: list[Column], path: str | None = None, parts: int | None = None) -> Listing:
    """Write rows in `order`, which should leave no ties."""
    spark = rows.sparkSession
    path = path or scratch_path(spark, "listing")
    dealt = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    placed = dealt.sortWithinPartitions(*order).withColumns(
        {
            "part": F.spark_partition_id(),
            "n": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1),  # counts within a partition
        }
    )
    placed.write.partitionBy("part").parquet(path)
    schema = placed.schema
    written = spark.read.schema(schema).parquet(path)
    starts, before = {}, 0
    for part, n in sorted(map(tuple, written.groupBy("part").count().collect())):  # a row per range
        starts[part] = (before, n)
        before += n
    return Listing(written, starts)
