"""Insert-if-absent on a primary key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Keys of so many rows are some ten megabytes as a broadcast table.
FEW_ROWS = 100_000


def first_by_key(batch: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """The first row of every key in ``order_by`` order.

    An aggregate rather than a ranking window, so copies of a key collapse on the
    map side however many there are.
    """
    picked = F.min_by(F.struct(*batch.columns), F.struct(*order_by)).alias("row")
    return batch.groupBy(*keys).agg(picked).select("row.*")


def insert_if_absent(
    target: DataFrame, batch: DataFrame, keys: list[str], order_by: list[str] | None = None, few: bool = False
) -> DataFrame:
    """The rows of ``batch`` to insert: one per key, none whose key is in ``target``.

    The keys are joined by sort: Spark's estimates of key columns cut out of wide rows are far too small, and a
    broadcast of them would fill the driver. A caller that has counted the batch may say that it holds ``few``
    rows (``FEW_ROWS`` at most); its keys are broadcast, and the stored ones are not shuffled.
    """
    incoming = first_by_key(batch, keys, order_by) if order_by else batch.dropDuplicates(keys)
    # Reduce the stored keys to those of the batch first: a big table is then only
    # scanned on its key columns, and the anti join shuffles hits alone.
    wanted = batch.select(*keys).distinct().hint("broadcast" if few else "merge")
    present = target.select(*keys).join(wanted, keys, "left_semi")
    return incoming.join(present.hint("merge"), keys, "left_anti")
