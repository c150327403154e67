"""Joins and row numbers that hold when one key owns a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloneflow.functions.text import portable_hash

# A key is hot when it holds more than 1/HOT_PARTS of the rows or of the bytes.
HOT_PARTS = 10_000
MIN_HOT_ROWS = 100_000
MIN_HOT_BYTES = 256 * 1024 * 1024
BROADCAST_BYTES = 64 * 1024 * 1024
SHARDS = 1024


def _bytes(col: Column, kind: T.DataType) -> Column:
    """Approximate bytes of one value, down to the strings inside arrays, structs and maps."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(col)
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        size = F.octet_length(F.array_join(col, "")) + 16 * F.size(col)
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.NumericType, T.BooleanType, T.DatetimeType)):
        size = 8 * F.size(col)
    elif isinstance(kind, T.ArrayType):
        inner = F.transform(col, lambda x: _bytes(x, kind.elementType))
        size = F.aggregate(inner, F.lit(0).cast("bigint"), lambda total, x: total + x + 8)
    elif isinstance(kind, T.StructType):
        size = sum((_bytes(col[f.name], f.dataType) for f in kind.fields), F.lit(8).cast("bigint"))
    elif isinstance(kind, T.MapType):
        size = _bytes(F.map_keys(col), T.ArrayType(kind.keyType)) + _bytes(F.map_values(col), T.ArrayType(kind.valueType))
    else:
        size = F.lit(8)
    return F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("bigint") + 8


def row_bytes(schema: T.StructType) -> Column:
    """Approximate bytes of a row."""
    return sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in schema.fields), F.lit(16).cast("bigint"))


def fits(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether `df` is small enough to broadcast: one aggregation, one number back."""
    return (df.agg(F.sum(row_bytes(df.schema))).first()[0] or 0) <= limit


def join_unique(
    big: DataFrame,
    unique: DataFrame,
    on: list[str],
    salt_by: list[str],
    how: str = "inner",
    counts: DataFrame | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
    min_hot_rows: int | None = None,
    small: bool | None = None,
    min_hot_bytes: int | None = None,
) -> DataFrame:
    """Join `big` with a side that has one row per key ("inner" or "left").

    A side whose measured size allows it is broadcast, so `big` is not shuffled at all. Otherwise both are
    shuffled, and every hot key of `big`, if there is any, is split over several salts with its one partner
    row repeated per salt. A key is hot by its rows or by their bytes. The salt is a hash of `salt_by`, so a
    recomputed task puts each row where it was before. `counts` (key columns and `n`, the rows of `big` per key)
    saves counting when it is known, and `small` saves measuring a side that was measured before.
    """
    if small if small is not None else fits(unique, broadcast_bytes):
        return big.join(F.broadcast(unique), on, how)
    if counts is None:
        counts = big.groupBy(*on).agg(F.count(F.lit(1)).alias("n"), F.sum(row_bytes(big.schema)).alias("b"))
    elif "b" not in counts.columns:
        counts = counts.withColumn("b", F.lit(0).cast("bigint"))
    rows, most, size, heaviest = counts.agg(F.sum("n"), F.max("n"), F.sum("b"), F.max("b")).first()
    part = max(min_hot_rows or MIN_HOT_ROWS, -(-(rows or 0) // HOT_PARTS))
    part_bytes = max(min_hot_bytes or MIN_HOT_BYTES, -(-(size or 0) // HOT_PARTS))
    if (most or 0) <= part and (heaviest or 0) <= part_bytes:
        return big.join(unique, on, how)
    salts = F.greatest(F.ceil(F.col("n") / F.lit(part)), F.ceil(F.col("b") / F.lit(part_bytes))).cast("int")
    hot = counts.where((F.col("n") > part) | (F.col("b") > part_bytes)).select(*on, salts.alias("_salts"))
    # At most 2 x HOT_PARTS rows: each stands for more than 1 / HOT_PARTS of the rows or bytes of `big`.
    hot = F.broadcast(hot)
    salts = F.coalesce("_salts", F.lit(1))
    salted = big.join(hot, on, "left").withColumn("_salt", F.pmod(F.xxhash64(*salt_by), salts).cast("int")).drop("_salts")
    partners = unique.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return salted.join(partners, [*on, "_salt"], how).drop("_salt")


def first_rows(df: DataFrame, by: str, order: str) -> DataFrame:
    """The row with the lowest `order` in each group, without moving a whole group to one task.

    `order` is unique within a group, so the join keys are unique and cannot be skewed.
    """
    lowest = df.groupBy(by).agg(F.min(order).alias(order))
    return df.join(lowest, [by, order], "left_semi")


def number_rows(df: DataFrame, order: str, by: list[str] | None = None, name: str = "idx", level: Column | None = None) -> DataFrame:
    """Dense numbers from 0, over the table or within the `by` groups, without one task per group.

    Rows are ranked inside hash shards of the (unique, string) `order` column, and each shard is shifted by the
    rows before it: the order is that of (shard, `order`). The offsets have at most SHARDS rows per group. With `level` (few whole numbers) the
    rows of a lower level come first; the offsets then have as many rows for each level.
    """
    by, parts = by or [], ["_shard"] if level is None else ["_level", "_shard"]
    sharded = df.withColumn("_shard", F.pmod(portable_hash(F.col(order)), F.lit(SHARDS)).cast("int"))
    if level is not None:
        sharded = sharded.withColumn("_level", level)
    sizes = sharded.groupBy(*by, *parts).agg(F.count(F.lit(1)).alias("_n"))
    if by:
        before = W.partitionBy(*by).orderBy(*parts).rowsBetween(W.unboundedPreceding, -1)
    else:
        sizes = sizes.withColumn("_all", F.lit(0))
        before = W.partitionBy("_all").orderBy(*parts).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*by, *parts, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    rank = F.row_number().over(W.partitionBy(*by, *parts).orderBy(order)) - 1
    ranked = sharded.withColumn("_rank", rank)
    return (
        ranked.join(offsets, [*by, *parts])
        .withColumn(name, (F.col("_offset") + F.col("_rank")).cast("bigint"))
        .drop(*parts, "_rank", "_offset")
    )
