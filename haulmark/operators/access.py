"""Reads and writes of keyed tables: id sets, ranges, pages, counts, insert-ignore, upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_ids(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows with an id of the set; ids that aren't there are silently absent."""
    return rows.join(ids.select(F.col(ids.columns[0]).alias(key)), key, "left_semi")


def in_range(rows: DataFrame, start: int, end: int) -> DataFrame:
    """Both ends inclusive, in order."""
    return rows.where(F.col("id").between(start, end)).select("id", "created_at").orderBy("id")


def page_after(rows: DataFrame, after: int, limit: int, key: str, more: tuple[str, ...] = ()) -> DataFrame:
    """The next page in key order: ids, and the columns that are asked for."""
    return rows.where(F.col(key) > after).select(key, *more).orderBy(key).limit(limit)


def max_id(rows: DataFrame, key: str = "id") -> DataFrame:
    """0 for an empty table."""
    return rows.agg(F.coalesce(F.max(key), F.lit(0)).alias("max_id"))


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of new whose keys old doesn't have; rows of old stay as they are."""
    return new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")


def upsert_latest(old: DataFrame, new: DataFrame, key: str, order: Column) -> DataFrame:
    """Every key's newest row: of new the one with the greatest order, which must not repeat within a key, else old's.
    Aggregation, not a window: a hot key's rows are combined before the shuffle."""
    columns = [c for c in old.columns if c != key]
    pick = lambda df, rank: df.select(key, F.struct(*columns).alias("row"), rank.alias("rank"))
    both = pick(old, F.lit(None).cast("long")).union(pick(new, order))
    latest = both.groupBy(key).agg(F.max_by("row", F.coalesce("rank", F.lit(-(1 << 63)))).alias("row"))
    return latest.select(key, "row.*")
