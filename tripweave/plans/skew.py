"""Joins that stay balanced when one key owns a large share of the rows.

A key is *hot* when it holds more than ``HOT_ROWS`` rows, or more than a millionth of all rows
where that is more.  Hot keys are split into salts; the other side is copied once per salt of
its own key, so the copies number at most rows / HOT_ROWS.  The list of hot keys is what gets
broadcast.  It is complete, and has fewer than ``MOST_HOT_KEYS`` rows by construction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 4_000_000
MOST_HOT_KEYS = 1_000_000
# Places over which rows without a key are spread.
_KEYLESS_SALTS = 1024

_SALT = "_salt"
_SALTS = "_salts"


def group_sizes(df: DataFrame, keys: Sequence[str], out: str = "_rows") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


def hot_keys(
    sized: DataFrame, keys: Sequence[str], size: str = "_rows", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Every key with more rows than the threshold, and its salt count."""
    return sized.filter(F.col(size) > threshold(sized, size, hot_rows)).select(
        *keys, salt_count(F.col(size), hot_rows).alias(_SALTS)
    )


def threshold(sized: DataFrame, size: str, least: int) -> Column:
    """``least``, or the millionth of the sum of ``size`` where that is more: no more than a
    million rows of ``sized`` can exceed it."""
    whole = sized.agg(F.sum(F.col(size).cast("double")).alias("whole")).scalar()
    return F.greatest(F.lit(float(least)), F.coalesce(whole, F.lit(0.0)) / MOST_HOT_KEYS)


def hot_keys_if_any(
    sized: DataFrame, keys: Sequence[str], size: str = "_rows", hot_rows: int = HOT_ROWS
) -> DataFrame | None:
    """As :func:`hot_keys`, or None where no key is hot; for sizes already materialised."""
    if (largest(sized, size) or 0) <= hot_rows:
        return None
    return hot_keys(sized, keys, size, hot_rows)


def largest(sized: DataFrame, size: str) -> int | None:
    return sized.agg(F.max(size)).first()[0]


def salt_count(size: Column, hot_rows: int) -> Column:
    return F.ceil(size / F.lit(hot_rows)).cast("int")


def salt_of(spread_by: Sequence[str], salts: Column) -> Column:
    """Salt taken from row content, so that a recomputed task places rows as before."""
    return F.pmod(F.xxhash64(*spread_by), salts.cast("long")).cast("int")


def all_salts(salts: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), salts - 1))


def spread_join(
    facts: DataFrame,
    dims: DataFrame,
    on: Sequence[str],
    spread_by: Sequence[str],
    hot: DataFrame | None,
    how: str = "inner",
) -> DataFrame:
    """Join ``facts`` (hot side) to ``dims``, splitting the rows of keys listed in ``hot``.

    ``spread_by`` names the columns of ``facts`` that tell rows of one key apart.  With
    no ``hot`` keys this is a plain join, but for rows without a key in a left join.
    """
    on = list(on)
    # Rows without a key match nothing; any place will do, but not all in one.
    keyless = F.lit(False)
    for name in on:
        keyless = keyless | F.col(name).isNull()
    spread = how == "left" and any(facts.schema[name].nullable for name in on)
    if hot is None:
        if not spread:
            return facts.join(dims, on, how)
        salt = F.when(keyless, salt_of(spread_by, F.lit(_KEYLESS_SALTS))).otherwise(0)
        # Always 0, but no literal: with one the optimizer would drop the salt from the join keys.
        none = F.pmod(F.hash(*on), F.lit(1))
        left, right = facts.withColumn(_SALT, salt), dims.withColumn(_SALT, none)
        return left.join(right, [*on, _SALT], how).drop(_SALT)
    hot = F.broadcast(hot)
    one = F.coalesce(F.col(_SALTS), F.lit(1))
    salt = salt_of(spread_by, one)
    if spread:
        salt = F.when(keyless, salt_of(spread_by, F.lit(_KEYLESS_SALTS))).otherwise(salt)
    left = facts.join(hot, on, "left").withColumn(_SALT, salt).drop(_SALTS)
    right = dims.join(hot, on, "left").withColumn(_SALT, all_salts(one)).drop(_SALTS)
    return left.join(right, [*on, _SALT], how).drop(_SALT)


def sized_join(
    facts: DataFrame,
    dims: DataFrame,
    on: Sequence[str],
    spread_by: Sequence[str],
    size: str,
    hot_rows: int = HOT_ROWS,
    how: str = "inner",
) -> DataFrame:
    """As :func:`spread_join`, when both sides already carry the group size in ``size``.

    Groups within ``hot_rows`` have one salt, so no list of hot keys is needed.
    """
    on = list(on)
    salts = salt_count(F.greatest(F.col(size), F.lit(1)), hot_rows)
    left = facts.withColumn(_SALT, salt_of(spread_by, salts))
    right = dims.withColumn(_SALT, all_salts(salts)).drop(size)
    return left.join(right, [*on, _SALT], how).drop(_SALT)
