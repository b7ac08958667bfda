"""Running numbers, sums and predecessors along ordered groups of any size, in two levels.

A window over a group puts the group in one task. Here rows are dealt by ranges of (group, order), so that a long group is cut over many
tasks; each task scans its pieces, and what the pieces before it come to is added. A piece is one row in the table of what comes
before: a group has as many as it was cut into, so the window over that table is small even if all rows are one group.

The dealt rows are written to the shared folder once: ranges are drawn by sampling, and every step must see the same ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbisplit.sources.tables import materialise

#: The column that numbers the tasks of a scan.
PIECE = "_piece"


class Scan:
    """Rows in groups (``by``: columns, none for one group of all rows) in order (``order``: columns, ascending, nulls first).

    Rows that agree in group and order lie in one piece, in any order: give an order without ties where it matters. Columns that begin
    with an underscore and a name used here (_piece, _before) may not be in the table."""

    def __init__(self, df: DataFrame, by: Sequence[str], order: Sequence[str], pieces: int | None = None) -> None:
        self.by, self.order = list(by), list(order)
        spark = df.sparkSession
        n = pieces or int(spark.conf.get("spark.sql.shuffle.partitions"))
        keys = [F.col(c).asc_nulls_first() for c in (*self.by, *self.order)]
        self.df = materialise(df.repartitionByRange(n, *keys).withColumn(PIECE, F.spark_partition_id()), "scan")

    def _next(self, df: DataFrame) -> Scan:
        out = object.__new__(Scan)
        out.by, out.order, out.df = self.by, self.order, df
        return out

    def _local(self) -> Window:
        return Window.partitionBy(PIECE, *self.by).orderBy(*[F.col(c).asc_nulls_first() for c in self.order])

    def _joined(self, pieces: DataFrame) -> DataFrame:
        """Rows with what their piece was given; groups may be null."""
        other = pieces.withColumnsRenamed({c: f"_before_{c}" for c in (PIECE, *self.by)})
        same = F.lit(True)
        for c in (PIECE, *self.by):
            same = same & self.df[c].eqNullSafe(other[f"_before_{c}"])
        return self.df.join(other, same).drop(*[f"_before_{c}" for c in (PIECE, *self.by)])

    def number(self, into: str, total: str | None = None) -> Scan:
        """Add the row's number in its group, from 1, and, if named, how many rows the group has."""
        w = Window.partitionBy(*self.by)
        sizes = self.df.groupBy(PIECE, *self.by).agg(F.count(F.lit(1)).alias("_before_n"))
        before = F.sum("_before_n").over(w.orderBy(PIECE)) - F.col("_before_n")
        pieces = sizes.select(PIECE, *self.by, before.alias("_before_rows"), F.sum("_before_n").over(w).alias("_before_all"))
        df = self._joined(pieces).withColumn(into, (F.row_number().over(self._local()) + F.col("_before_rows")).cast("long"))
        return self._next((df.withColumnRenamed("_before_all", total) if total else df.drop("_before_all")).drop("_before_rows"))

    def running(self, sums: dict[str, Column]) -> Scan:
        """Add sums over the group's rows up to this one; nulls count as nothing."""
        w = Window.partitionBy(*self.by).orderBy(PIECE)
        zero = lambda c: F.coalesce(c, F.lit(0))
        parts = self.df.groupBy(PIECE, *self.by).agg(*[F.sum(zero(x)).alias(f"_before_{c}") for c, x in sums.items()])
        pieces = parts.select(PIECE, *self.by, *[(F.sum(f"_before_{c}").over(w) - F.col(f"_before_{c}")).alias(f"_before_{c}") for c in sums])
        upto = self._local().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        df = self._joined(pieces).withColumns({c: F.sum(zero(x)).over(upto) + F.col(f"_before_{c}") for c, x in sums.items()})
        return self._next(df.drop(*[f"_before_{c}" for c in sums]))

    def previous(self, columns: dict[str, str]) -> Scan:
        """Add columns (new name: column) of the row before in the group; null for the first."""
        held = F.struct(*[F.col(c).alias(new) for new, c in columns.items()])
        last = F.max_by(held, F.struct(*self.order)).alias("_before_last")
        parts = self.df.groupBy(PIECE, *self.by).agg(last)
        pieces = parts.withColumn("_before_last", F.lag("_before_last").over(Window.partitionBy(*self.by).orderBy(PIECE)))
        df = self._joined(pieces).withColumn("_before_last", F.coalesce(F.lag(held).over(self._local()), F.col("_before_last")))
        return self._next(df.withColumns({new: F.col("_before_last")[new] for new in columns}).drop("_before_last"))

    def add(self, columns: dict[str, Column]) -> Scan:
        return self._next(self.df.withColumns(columns))

    def rows(self) -> DataFrame:
        return self.df.drop(PIECE)
