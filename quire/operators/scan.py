"""Running values over keys of any size: a prefix scan in two levels.

A window by key sends all rows of a key to one task. Here rows are dealt by ranges of (key,
order) instead, so that a large key is spread over several ranges, and written as a table.
Each range is scanned by itself, in windows by key and range. What a range hands on to the next
is the state of its last key: one row a range. The states of the ranges before it, as far as
they are of the same key, are combined by a window over these few rows, and the result is
broadcast back and added to the rows of the first key of each range.

A task never reads more than one range, and its windows never more than the rows of a key in a
range. Sorting is by the order columns, ascending, nulls first; rows that are equal in all of
them are in one range, in no fixed order. Null keys are a key of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.session import persist_table


class Ranges:
    """rows in ranges of keys and order (names of columns); each method adds columns and returns the same object."""

    def __init__(self, rows: DataFrame, keys: Sequence[str], order: Sequence[str], ranges: int | None = None) -> None:
        self.keys, self.order = list(keys), list(order)
        n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = rows.repartitionByRange(n, *self.keys, *self.order).withColumn("_range", F.spark_partition_id())
        self._rows = persist_table(dealt, "ranges")
        key = F.struct(*self.keys) if self.keys else F.struct(F.lit(0))
        self._key = key
        self._ends = persist_table(self._rows.groupBy("_range").agg(F.min(key).alias("_first"), F.max(key).alias("_last")), "ends")
        self._own = W.partitionBy(*self.keys, "_range").orderBy(*self.order)

    def rows(self) -> DataFrame:
        return self._rows.drop("_range")

    def _add(self, name: str, local: Column, state: Column, prefix: Callable[[Column], Column], join: Callable[[Column, Column], Column]) -> Ranges:
        """local: the value within a key and range; state: of all rows of a range's last key, as an aggregate; prefix: how states combine; join: local and carried value."""
        tails = self._rows.join(F.broadcast(self._ends.select("_range", "_last")), "_range").filter(self._key.eqNullSafe(F.col("_last"))).groupBy("_range").agg(state.alias("_state"))
        few = self._ends.join(F.broadcast(tails), "_range", "left")
        upto = few.withColumn("_upto", prefix(F.col("_state")).over(W.partitionBy("_last").orderBy("_range").rowsBetween(W.unboundedPreceding, 0)))
        before = W.orderBy("_range")  # of as many rows as there are ranges
        carried = upto.withColumn("_carried", F.when(F.lag("_last").over(before).eqNullSafe(F.col("_first")), F.lag("_upto").over(before))).select("_range", "_first", "_carried")
        told = self._rows.withColumn(name, local).join(F.broadcast(carried), "_range")
        own = F.when(self._key.eqNullSafe(F.col("_first")), F.col("_carried"))
        self._rows = told.withColumn(name, join(F.col(name), own)).drop("_first", "_carried")
        return self

    def _upto(self) -> W:
        return self._own.rowsBetween(W.unboundedPreceding, 0)

    def running(self, name: str, value: Column) -> Ranges:
        """The sum of value over the rows of a key up to each row; nulls count as nothing."""
        zero = F.lit(0)
        return self._add(name, F.coalesce(F.sum(value).over(self._upto()), zero), F.sum(value), F.sum, lambda x, c: x + F.coalesce(c, zero))

    def number(self, name: str) -> Ranges:
        """1, 2, 3 ... by key."""
        return self.running(name, F.lit(1).cast("long"))

    def greatest(self, name: str, value: Column) -> Ranges:
        """The greatest value of a key up to each row."""
        return self._add(name, F.max(value).over(self._upto()), F.max(value), F.max, lambda x, c: F.greatest(x, c))

    def last(self, name: str, value: Column) -> Ranges:
        """The last value of a key up to each row that isn't null."""
        state = F.max_by(value, F.when(value.isNotNull(), F.struct(*self.order)))
        return self._add(name, F.last(value, ignorenulls=True).over(self._upto()), state, lambda s: F.last(s, ignorenulls=True), F.coalesce)

    def before(self, name: str, value: Column) -> Ranges:
        """The value of the row before, null at the first row of a key."""
        held = F.struct(value.alias("v"))
        self._add(name, F.lag(held).over(self._own), F.max_by(held, F.struct(*self.order)), lambda s: F.last(s, ignorenulls=True), F.coalesce)
        self._rows = self._rows.withColumn(name, F.col(name)["v"])
        return self
