"""Running values over long groups: a group's rows are cut into blocks in order, blocks are solved apart, and what crosses their
boundaries is scanned and carried into them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netlens.operators.scratch import written

c = F.col

#: Kinds of running values: what it is over rows, and how what came before a block joins what is inside.
_KINDS = {
    "sum": (F.sum, lambda carry, inside: F.coalesce(carry + inside, carry, inside)),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
    "last": (lambda x: F.last(x, ignorenulls=True), lambda carry, inside: F.coalesce(inside, carry)),
}


def running(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], columns: dict[str, tuple[str, Column, bool]], blocks: int | None = None) -> DataFrame:
    """rows with running values inside each group of keys: columns maps a name to (kind, value, with the row itself), kind being sum, max, min
    or last (the last that is not null).

    Without `blocks` these are windows, and a group is one task. With it the table is sorted into so many ranges of keys and order, so
    that a group with half of all rows lies in half of the blocks; windows run inside (block, group), each block's total goes into
    a window over a group's blocks, and every row takes what was carried into its block. The ranges are written once, as two passes
    read them. Keys are not null; rows that are equal in keys and order are in one block.
    """
    frames = {True: 0, False: -1}
    by = [c(o) if isinstance(o, str) else o for o in order]
    window = lambda parts, inclusive: Window.partitionBy(*parts).orderBy(*by).rowsBetween(Window.unboundedPreceding, frames[inclusive])
    within = lambda parts: {n: _KINDS[kind][0](value).over(window(parts, inclusive)) for n, (kind, value, inclusive) in columns.items()}
    if not blocks:
        return rows.withColumns(within(keys))
    cut = written(rows.repartitionByRange(blocks, *map(c, keys), *by).withColumn("_block", F.spark_partition_id()), "blocks")
    groups = ["_block", *keys]
    last = lambda value: F.max_by(value, F.when(value.isNotNull(), F.struct(*by)))
    totals = cut.groupBy(*groups).agg(*((last(value) if kind == "last" else _KINDS[kind][0](value)).alias(f"_t_{n}") for n, (kind, value, _) in columns.items()))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*groups, *(_KINDS[kind][0](c(f"_t_{n}")).over(before).alias(f"_c_{n}") for n, (kind, _, _) in columns.items()))
    out = cut.withColumns(within(groups)).join(carried, groups, "left")
    return out.withColumns({n: _KINDS[kind][1](c(f"_c_{n}"), c(n)) for n, (kind, _, _) in columns.items()}).drop("_block", *(f"_c_{n}" for n in columns))


def previous(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], values: Sequence[str], name: str, blocks: int) -> DataFrame:
    """rows with a struct `name` of the values of the row before, in blocks."""
    return running(rows, keys, order, {name: ("last", F.struct(*values), False)}, blocks)
