"""Building blocks whose tasks stay small however the rows are spread over the keys.

One project may hold a third of the corpus. Numbering, neighbour lookup and key lookup
are therefore written so that no window partition, join partition or collected value
grows with the size of a project.
"""

from bisect import bisect_right
from collections.abc import Sequence
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

NULL_SALTS = 4096


def _placed(df: DataFrame, group: list[str], order: list[str], ranges: int | None = None) -> DataFrame:
    """``df`` sorted by (group, order) over all tasks, with ``__part``, its place among the ranges, and ``__at``, its place in the range; kept.

    A hot group lies in several ranges, many small groups share one.
    """
    keys = [*group, *order]
    ranged = (df.repartitionByRange(ranges, *keys) if ranges else df.repartitionByRange(*keys)).sortWithinPartitions(*keys)
    return materialize(ranged.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}))


def _range_starts(placed: DataFrame, group: list[str], weight: Column) -> DataFrame:
    """(__part, group, __from, __before, __total) for every group of every range; kept.

    ``__before`` is the group's weight in earlier ranges. A window sees one row per range at most.
    """
    parts = placed.groupBy("__part", *group).agg(F.min("__at").alias("__from"), F.sum(weight).alias("__n"))
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return materialize(
        parts.select("__part", *group, "__from", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"), F.sum("__n").over(whole).alias("__total"))
    )


def running_start(df: DataFrame, group: Sequence[str], order_id: str, weight: Column) -> DataFrame:
    """Add ``_start``, the sum of weights of earlier ids, and ``_total``, that of the group.

    Rows are sorted into ranges once; a window sees the rows of one group in one range, and the weight of
    earlier ranges is added. Group columns must not be NULL; ``df`` should be narrow.
    """
    group = list(group)
    placed = _placed(df.withColumn("__w", weight), group, [order_id])
    here = Window.partitionBy("__part", *group).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.withColumn("__inside", F.coalesce(F.sum("__w").over(here), F.lit(0)))
    joined = inside.join(_range_starts(placed, group, F.col("__w")), ["__part", *group])
    return joined.withColumn("_start", F.col("__before") + F.col("__inside")).select(*df.columns, "_start", F.col("__total").alias("_total"))


def ordinal(
    df: DataFrame, group: Sequence[str], order_id: str, out: str = "ord", total: str | None = None, within: str | None = None
) -> DataFrame:
    """Number the rows of each group 0, 1, 2, … in the order of an id.

    The id must be unique within the group, or unique together with ``within``, a
    position inside the id (such as a match inside a file). ``total`` adds the size of
    the group. Rows are sorted into ranges once and kept; a row's number is its place in the range, shifted by
    the rows of its group in earlier ranges, so no task sees more than a range, whatever the ids are and
    however large a group is. Group columns must not be NULL; ``df`` should be narrow.
    """
    group = list(group)
    placed = _placed(df, group, [order_id] if within is None else [order_id, within])
    numbered = placed.join(_range_starts(placed, group, F.lit(1)), ["__part", *group])
    number = (F.col("__before") + F.col("__at") - F.col("__from")).cast("long").alias(out)
    return numbered.select(*df.columns, number, *([F.col("__total").cast("long").alias(total)] if total else []))


def neighbours(df: DataFrame, group: Sequence[str], order_id: str, value: str) -> DataFrame:
    """Add ``prev_<value>`` and ``next_<value>`` in id order within each group.

    Rows are sorted into ranges once. Inside a range these are ``lag`` and ``lead``; the first and last row of
    a range look at the edge rows of the ranges beside it, one row for each range. Group columns must not be NULL.
    """
    group = list(group)
    placed = _placed(df, group, [order_id])
    edge = F.struct(*[F.col(c).alias(f"_g{n}") for n, c in enumerate(group)], F.col(value).alias("_value"))
    edges = placed.groupBy("__part").agg(F.min_by(edge, "__at").alias("__first"), F.max_by(edge, "__at").alias("__last"))
    # one row for each range
    order = Window.partitionBy(F.lit(0)).orderBy("__part")
    edges = edges.select("__part", F.lag("__last").over(order).alias("__before"), F.lead("__first").over(order).alias("__after"))
    here = Window.partitionBy("__part").orderBy("__at")
    same = lambda side: F.lit(True) if not group else reduce(and_, [F.col(f"{side}._g{n}") == F.col(c) for n, c in enumerate(group)])
    inside = placed.withColumns({"__lag": F.lag(edge).over(here), "__lead": F.lead(edge).over(here)}).join(F.broadcast(materialize(edges)), "__part")

    def beside(near: str, far: str) -> Column:
        return F.when(F.col(near).isNull(), F.when(same(far), F.col(f"{far}._value"))).when(same(near), F.col(f"{near}._value"))

    return inside.select(*df.columns, beside("__lag", "__before").alias(f"prev_{value}"), beside("__lead", "__after").alias(f"next_{value}"))


def numbered_once(df: DataFrame, group: str, order_id: str, narrow: DataFrame | None = None) -> DataFrame:
    """Sort wide rows by (group, id) over all tasks with one exchange, and add ``ord`` and ``is_last`` within the group.

    ``narrow``, by default the two columns of ``df``, is sorted into ranges first; the first row of every range and the rows of its group
    before it, one of each for a range, become constants of a small function that says which range a row belongs to. So rows are
    numbered where they arrive, and written in that order; wide columns are moved once. Group and id
    must not be NULL, and unique together.
    """
    # wide rows follow the ranges of the narrow ones, so there are as many as shuffle partitions, however narrow those are
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = _placed((df if narrow is None else narrow).select(group, order_id), [group], [order_id], tasks)
    edge = F.struct(F.col(group).alias("g"), F.col(order_id).alias("i"))
    ranges = placed.groupBy("__part").agg(
        F.min_by(edge, "__at").alias("first"), F.max_by(edge, "__at").alias("last")
    )
    last_rows = placed.join(F.broadcast(ranges.select("__part", F.col("last.g").alias("__g"))), "__part").filter(F.col(group) == F.col("__g"))
    in_last = {r["__part"]: r["count"] for r in last_rows.groupBy("__part").count().collect()}  # one row for each range, here and below
    listed = sorted(((r["__part"], r["first"], r["last"]) for r in ranges.select("__part", "first", "last").collect()), key=lambda r: r[0])
    starts = [(first["g"], first["i"]) for _, first, _ in listed]
    shifts, ends, running, before = [], [], 0, None
    for k, (part, first, last) in enumerate(listed):
        shifts.append(running if before == first["g"] else 0)
        running = in_last[part] + (running if before == first["g"] == last["g"] else 0)
        before = last["g"]
        ends.append(k + 1 == len(listed) or listed[k + 1][1]["g"] != last["g"])
    lasts = [last["g"] for _, _, last in listed]

    @F.pandas_udf("slot int, shift long, ends boolean")
    def place(groups: pd.Series, ids: pd.Series) -> pd.DataFrame:
        rows = []
        for g, i in zip(groups, ids, strict=True):
            slot = max(0, bisect_right(starts, (g, i)) - 1)
            rows.append((slot, shifts[slot] if g == starts[slot][0] else 0, g != lasts[slot] or ends[slot]))
        return pd.DataFrame(rows, columns=["slot", "shift", "ends"])

    slotted = df.withColumn("__to", place(F.col(group), F.col(order_id))).withColumn("__slot", F.col("__to.slot"))
    ranged = slotted.repartitionByRange(max(1, len(listed)), "__slot").sortWithinPartitions("__slot", group, order_id)
    here = Window.partitionBy("__slot", group).orderBy(order_id)
    numbered = ranged.withColumn("ord", (F.row_number().over(here) - 1 + F.col("__to.shift")).cast("long"))
    return numbered.withColumn("is_last", F.lead(order_id).over(here).isNull() & F.col("__to.ends")).drop("__to", "__slot")


def first_n(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], n: int, out: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group.

    The limit on ``row_number`` lets Spark cut every partition to ``n`` rows per group
    before the shuffle, so a hot group costs no more than a small one.
    """
    rank = out or "_rank"
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col(rank) <= n)
    return ranked if out else ranked.drop(rank)


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    spread: str | Column,
    how: str = "left",
    rows_per_task: int = 1_000_000,
) -> DataFrame:
    """Join many ``rows`` to a ``lookup`` with one row per key, whatever the key skew.

    Keys with more than ``rows_per_task`` rows are split: their rows get one of as many
    salts as tasks are wanted, and only their lookup rows are repeated, once per salt. The
    broadcast list has the largest such keys, as many as there are shuffle partitions at
    most; a key beyond it has less than an average partition's rows. Rows with a NULL key
    match nothing and are spread over all tasks. ``rows`` is read twice, so pass a table or
    a materialized frame when it is costly to compute.
    """
    keys = list(keys)
    load = rows.groupBy(*keys).agg(F.count("*").alias("_load"))
    most = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heavy = load.filter(F.col("_load") > rows_per_task).orderBy(F.desc("_load"), *keys).limit(most)
    hot = heavy.select(
        *keys, F.ceil(F.col("_load") / rows_per_task).cast("int").alias("_parts")
    )
    spread = F.col(spread) if isinstance(spread, str) else spread
    any_null = F.lit(False)
    for key in keys:
        any_null = any_null | F.col(key).isNull()
    salt = F.when(any_null, -1 - F.pmod(F.xxhash64(spread), F.lit(NULL_SALTS))).otherwise(
        F.coalesce(F.pmod(F.xxhash64(spread), F.col("_parts")), F.lit(0))
    )
    salted_rows = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt.cast("long")).drop("_parts")
    salted_lookup = (
        lookup.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)).cast("long") - 1)))
        .drop("_parts")
    )
    return salted_rows.join(salted_lookup, [*keys, "_salt"], how).drop("_salt")

