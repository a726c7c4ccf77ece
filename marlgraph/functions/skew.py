"""Joins in which one key may hold a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of the rows on; so there are at most 1 / HOT_SHARE hot keys, which bounds what is broadcast.
HOT_SHARE = 1 / 1000


def hot_keys(rows: DataFrame, keys: Sequence[str], share: float = HOT_SHARE) -> list[tuple]:
    """Keys holding at least `share` of the rows: at most 1/share of them. Counts are combined before the shuffle."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    view = counts.agg(F.sum("_n").alias("_all"))
    found = counts.where(F.col("_n") >= F.greatest(F.ceil(view.scalar() * F.lit(share)), F.lit(1000)))
    return [tuple(r[k] for k in keys) for r in found.select(*keys).collect()]


def is_key_in(keys: Sequence[str], values: list[tuple]):
    """A literal test on a bounded list of keys."""
    if len(keys) == 1:
        return F.col(keys[0]).isin([v[0] for v in values])
    return F.struct(*keys).isin([F.struct(*[F.lit(x).alias(k) for x, k in zip(v, keys)]) for v in values])


def join_skewed(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", share: float = HOT_SHARE) -> DataFrame:
    """Joins left rows of any skew to a right side with one row per key (left or inner).

    Rows of hot keys keep their place: the right side's rows of those keys, at most 1/share, are broadcast. All others are shuffled.
    """
    hot = hot_keys(left, keys, share)
    if not hot:
        return left.join(right, list(keys), how)
    test = F.coalesce(is_key_in(keys, hot), F.lit(False))
    apart = left.where(test).join(F.broadcast(right.where(test)), list(keys), how)
    return left.where(~test).join(right, list(keys), how).unionByName(apart)
