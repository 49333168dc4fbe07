"""Pages of a listing by order statistics: any page reads one or two ranges of the sort key, however deep it is."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, functions as F

from kgspark.operators.staging import MAX_PAGE, Listing, listing_order, matching
from kgspark.sources.versions import written

#: Rows of one range of the sort key; a page sorts as many.
RANGE_ROWS = 200_000


class PageIndex:
    """The rows of a listing as they are now, written by range of (sort key, id), and the number of rows in each range.

    Rows with equal sort keys are ordered by id, which must be unique, and may lie in several ranges. The driver holds one
    number per range. Null sort keys come last when descending, else first.
    """

    def __init__(self, rows: DataFrame, listing: Listing, sortable: list[str], range_rows: int = RANGE_ROWS):
        found = matching(rows, listing)
        self.listing, self.columns = listing, found.columns
        self.order = [*listing_order(listing, sortable), F.col("id").asc()]
        self.name = "range"
        while self.name in self.columns:
            self.name += "_"
        ranges = max(1, -(-found.count() // range_rows))
        placed = found.repartitionByRange(ranges, *self.order).withColumn(self.name, F.spark_partition_id())
        self.table = written(placed, self.name)
        sizes = {r[self.name]: r["n"] for r in self.table.groupBy(self.name).agg(F.count(F.lit(1)).alias("n")).collect()}
        self.ranges = sorted(sizes)
        self.before = [0, *accumulate(sizes[r] for r in self.ranges)]

    def total(self) -> int:
        return self.before[-1]

    def page(self, number: int) -> DataFrame:
        """Page ``number``, from 1; beyond the last page no row."""
        size = self.listing.page_size
        if not 1 <= size <= MAX_PAGE or number < 1:
            raise ValueError(f"page_size must be 1..{MAX_PAGE}, a page's number at least 1")
        start = (number - 1) * size
        low = max(0, bisect_right(self.before, start) - 1)
        wanted = [r for r, before in zip(self.ranges, self.before) if before < start + size][low:]
        some = self.table.filter(F.col(self.name).isin(wanted)).select(*self.columns)
        skipped = start - self.before[low] if wanted else 0
        return some.orderBy(*self.order).offset(skipped).limit(size)
