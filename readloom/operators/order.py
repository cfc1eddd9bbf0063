"""Rows in a global order without a single sorted partition: neighbours, running sums and row numbers over ranges of the order.

Rows are range-partitioned and sorted once, as a written table; what crosses from one range to the next (a first and last row, a sum, a count) is one row a
range, which the driver adds up. So one file, or one key, with a third of all rows is spread over as many ranges as its size asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.session import written

_BITS = 33  # monotonically_increasing_id: partition number above the row's number in it


class Ordered:
    """A DataFrame in the order of some columns; df has __p, the range, and __i, the row in it, both in order."""

    def __init__(self, df: DataFrame, *order: str):
        at = F.col("__order_id")
        table = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__order_id", F.monotonically_increasing_id()), "ordered")[0]
        self.df = table.withColumns({"__p": F.shiftright(at, _BITS), "__i": at.bitwiseAND(F.lit((1 << _BITS) - 1))}).drop("__order_id")
        self.columns = df.columns

    def _per_range(self, *aggs: Column) -> list:
        return sorted(self.df.groupBy("__p").agg(*aggs).collect(), key=lambda r: r["__p"])  # one row a range

    def _with_offset(self, values: list[tuple[int, int]], name: str) -> DataFrame:
        small = self.df.sparkSession.createDataFrame(values, f"__p bigint, {name} bigint")
        return self.df.join(F.broadcast(small), "__p")

    def numbered(self, name: str) -> tuple[DataFrame, int]:
        """The rows with their number 0, 1, ... in the order, and how many there are."""
        before, offsets = 0, []
        for p, n in self._per_range(F.count("*").alias("n")):
            offsets.append((p, before))
            before += n
        return self._with_offset(offsets, "__o").withColumn(name, F.col("__i") + F.col("__o")).select(*self.columns, name), before

    def with_neighbours(self, *columns: str) -> Ordered:
        """With __prev_<c> and __next_<c> of the rows beside; null at either end of the order."""
        box = F.struct(*columns)
        ends = self._per_range(F.min_by(box, "__i").alias("first"), F.max_by(box, "__i").alias("last"))
        schema = self.df.select(F.col("__p"), box.alias("__before"), box.alias("__after")).schema
        rows = [(r["__p"], ends[k - 1]["last"] if k else None, ends[k + 1]["first"] if k + 1 < len(ends) else None) for k, r in enumerate(ends)]
        for f in schema.fields[1:]:
            f.nullable = True
        beside = F.broadcast(self.df.sparkSession.createDataFrame(rows, schema))
        w = Window.partitionBy("__p").orderBy("__i")
        shifted = self.df.withColumns({"__lag": F.lag(box).over(w), "__lead": F.lead(box).over(w)}).join(beside, "__p")
        prev, following = F.coalesce("__lag", "__before"), F.coalesce("__lead", "__after")
        new = {f"__prev_{c}": prev[c] for c in columns} | {f"__next_{c}": following[c] for c in columns}
        out = object.__new__(Ordered)
        out.df, out.columns = shifted.withColumns(new).drop("__lag", "__lead", "__before", "__after"), [*self.columns, *new]
        return out

    def running(self, value: Column, name: str) -> DataFrame:
        """The rows with the sum of a whole number over all rows up to their own."""
        mine = self.df.withColumn("__v", value.cast("bigint"))
        before, offsets = 0, []
        for p, n in sorted(mine.groupBy("__p").agg(F.sum("__v").alias("n")).collect(), key=lambda r: r[0]):
            offsets.append((p, before))
            before += n or 0
        small = F.broadcast(self.df.sparkSession.createDataFrame(offsets, "__p bigint, __o bigint"))
        w = Window.partitionBy("__p").orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)
        return mine.join(small, "__p").withColumn(name, F.sum("__v").over(w) + F.col("__o")).select(*self.columns, name)
