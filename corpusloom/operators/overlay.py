"""Values from several layers: per key, the highest layer that has one."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlay(layers: Sequence[DataFrame], keys: Sequence[str], value: str = "value", default: Column | None = None) -> DataFrame:
    """First non-null ``value`` per key over ``layers``, the strongest layer first.

    ``default`` fills keys that no layer has a value for; it may depend on the key columns.

    Layers are stacked and folded by an ordinary aggregate, so each row meets its key's
    best value on the map side first and a hot key costs one row per task.
    """
    count = len(layers)
    stacked = reduce(
        DataFrame.unionByName,
        [layer.select(*keys, value, F.lit(count - i).alias("_priority")) for i, layer in enumerate(layers)],
    )
    best = F.max_by(F.struct(value, "_priority"), F.when(F.col(value).isNotNull(), F.col("_priority")))
    found = F.col(f"_best.{value}")
    return stacked.groupBy(*keys).agg(best.alias("_best")).select(
        *keys,
        (found if default is None else F.coalesce(found, default)).alias(value),
        F.when(found.isNotNull(), F.col("_best._priority")).otherwise(0).alias("layer_priority"),
    )
