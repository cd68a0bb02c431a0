"""Messages delivered at least once: keep exactly one copy of each.

Ids are brought to one notation, rows of an id are ranked by arrival with a total tie-break and only the first ranks
are kept. The rank filter is a group limit, which Spark applies before the shuffle as well as after it, so an id with
very many copies sends at most `ranks` rows per input partition to its task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def canonical_uuid(c: Column) -> Column:
    """Lower-case UUID with hyphens, however it was written; null for null, empty or anything that is no UUID."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)\s", ""), r"^(urn:uuid:)|[{}()\-]", "")
    hexed = F.regexp_replace(bare, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(bare.rlike("^[0-9a-f]{32}$"), hexed)


def message_id(c: Column) -> Column:
    """The UUID in one notation; another non-blank id as it is, trimmed; null where there is no id."""
    plain = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.coalesce(canonical_uuid(c), F.when(plain != "", plain))


def instant_seconds(c: Column) -> Column:
    """Epoch seconds from epoch digits or ISO text with or without a zone; null where unreadable."""
    text = F.trim(c)
    digits = F.when(text.rlike(r"^-?\d{1,15}$"), text.try_cast("bigint"))
    epoch = F.when(F.abs(digits) > 100_000_000_000, F.floor(digits / 1000)).otherwise(digits)
    return F.coalesce(epoch, F.try_to_timestamp(text).cast("long"))


def ranked_deliveries(df: DataFrame, key: list[str], arrival: str, ties: list[str], ranks: int = 1, into: str = "delivery_no") -> DataFrame:
    """The first `ranks` copies by key, numbered in column `into`; rows with a null key column must be set apart before."""
    if into in df.columns:
        raise ValueError(f"{into} is already a column")
    order = [F.col(arrival).asc_nulls_last(), *[F.col(t).asc_nulls_first() for t in ties]]
    ranked = df.withColumn(into, F.row_number().over(W.partitionBy(*key).orderBy(*order)))
    return ranked.where(F.col(into) <= ranks)


def first_deliveries(df: DataFrame, id_col: str, arrival: str, ties: list[str], channel: list[str] | None = None) -> DataFrame:
    """One row per id (the first to arrive); rows without an id are left as they are."""
    key = [*(channel or []), id_col]
    kept = ranked_deliveries(df.where(F.col(id_col).isNotNull()), key, arrival, ties, 1, "__delivery_no").drop("__delivery_no")
    return kept.unionByName(df.where(F.col(id_col).isNull()))


def new_messages(batch: DataFrame, stored_ids: DataFrame, id_col: str, arrival: str, ties: list[str]) -> DataFrame:
    """A new batch against the identifiers already stored: an anti-join, then one row per new id.

    The batch is reduced to one row per id first, so neither side of the anti-join has a hot key.
    """
    fresh = first_deliveries(batch, id_col, arrival, ties)
    with_id = fresh.where(F.col(id_col).isNotNull()).join(stored_ids.select(id_col).distinct(), id_col, "left_anti")
    return with_id.select(*fresh.columns).unionByName(fresh.where(F.col(id_col).isNull()))
