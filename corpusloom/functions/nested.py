"""Merging nested values: the right side wins, objects recurse, arrays are replaced."""

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType


def merge_maps(left: Column, right: Column) -> Column:
    """Flat key/value objects; a key present on the right replaces the left one."""
    kept = F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k))
    return F.when(left.isNull(), right).when(right.isNull(), left).otherwise(F.map_concat(kept, right))


def deep_merge(left: Column, right: Column, left_type: DataType, right_type: DataType) -> Column:
    """Structs, field by field and level by level. A NULL field counts as absent."""
    if not (isinstance(left_type, StructType) and isinstance(right_type, StructType)):
        return F.coalesce(right, left)
    names = list(dict.fromkeys(left_type.names + right_type.names))
    fields = []
    for name in names:
        if name not in right_type.names:
            fields.append(left.getField(name).alias(name))
        elif name not in left_type.names:
            fields.append(right.getField(name).alias(name))
        else:
            fields.append(
                deep_merge(left.getField(name), right.getField(name), left_type[name].dataType, right_type[name].dataType).alias(name)
            )
    return F.when(left.isNull() & right.isNull(), F.lit(None)).otherwise(F.struct(*fields))


#: Objects inside objects that ``merge_variants`` follows.
VARIANT_LEVELS = 16


def _fields(value: Column) -> Column:
    """An object's fields; NULL for a value of any other kind."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def merge_variants(left: Column, right: Column, levels: int = VARIANT_LEVELS) -> Column:
    """Two VARIANT values of any shape: objects merge field by field and level by level, the right side wins.

    Arrays and scalars are replaced; a field that is ``null`` on the right becomes ``null``. On the top
    level an object is kept when the right side is a scalar or ``null``. SQL NULL counts as absent. Objects
    on both sides below ``levels`` objects raise an error.
    """

    def merged(one: Column, two: Column, left_levels: int) -> Column:
        if left_levels == 0:
            told = F.raise_error(F.lit(f"objects lie deeper than {levels} levels")).cast("variant")
            return F.when(_fields(one).isNotNull() & _fields(two).isNotNull(), told).otherwise(two)
        fields = F.coalesce(_fields(one), F.create_map().cast("map<string,variant>"))
        each = F.map_zip_with(fields, _fields(two), lambda _, a, b: F.when(b.isNull(), a).otherwise(merged(a, b, left_levels - 1)))
        return F.when(_fields(two).isNotNull(), F.to_variant_object(each)).otherwise(two)

    scalar = _fields(right).isNull() & F.try_variant_get(right, "$", "array<variant>").isNull()
    return F.when(right.isNull() | (_fields(left).isNotNull() & scalar), left).otherwise(merged(left, right, levels))
