"""Deterministic, partition-independent ordering.

All randomness in the library derives from ``md5(key || '-' || seed)`` so a
result does not depend on partitioning or task retries, and DuckDB computes
the same order (used by the oracle checks). The *order token* is the hash
followed by the key itself, so plain string comparison orders rows by
(hash, key): ties on the hash are broken by the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = "_tok"
GROUP = "_grp"


def key_string(*cols) -> Column:
    """Stable string key from one or more columns (cast to string, '-' joined)."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.concat_ws("-", *[p.cast("string") for p in parts])


def hash_hex(key: Column, seed) -> Column:
    """md5 hex of ``key || '-' || seed``."""
    return F.md5(F.concat(key, F.lit(f"-{seed}")))


def order_token(key: Column, seed) -> Column:
    """``md5(key-seed) || '|' || key``: compares like (hash, key)."""
    return F.concat(hash_hex(key, seed), F.lit("|"), key)


def uniform_int(text: Column, modulus: Column) -> Column:
    """Uniform integer in [0, modulus) from the md5 of ``text`` (60 bits)."""
    h = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
    return F.pmod(h, modulus.cast("bigint"))


def uniform01(text: Column) -> Column:
    """Uniform double in [0, 1) from the md5 of ``text`` (52 bits)."""
    h = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")
    return h.cast("double") / F.lit(float(1 << 52))


def group_key(by: list[str] | None) -> Column:
    """One string column naming the group (empty string when ungrouped)."""
    if not by:
        return F.lit("")
    return F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in by])


def with_token(df: DataFrame, key: Column, seed) -> DataFrame:
    return df.withColumn(TOKEN, order_token(key, seed))


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 of a timestamp, independent of the session time zone.

    Driver tables carry wall-clock timestamps without zone; casting them to
    a zoned timestamp would shift them by the session offset.
    """
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                            ts.cast("timestamp_ntz"))


def epoch_millis(ts: Column) -> Column:
    """Milliseconds since the epoch (truncated), independent of the session time zone."""
    return F.floor(epoch_micros(ts) / F.lit(1000)).cast("long")
