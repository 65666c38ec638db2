"""Seeded, engine-neutral randomness: order rows by a hash of their key."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SEED = 42


def id_text(*ids: Column | str) -> Column:
    cols = [F.col(i) if isinstance(i, str) else i for i in ids]
    return F.concat_ws("|", *[c.cast("string") for c in cols])


def order_key(*ids: Column | str, seed: int = SEED) -> Column:
    """A total order that looks random: 32 hash digits, then the key itself."""
    text = id_text(*ids)
    return F.concat(F.md5(F.concat(F.lit(f"{seed}:"), text)), F.lit(":"), text)


def hash_bucket(*ids: Column | str, buckets: int = 10, seed: int = SEED) -> Column:
    """Bucket number 0 .. buckets-1 from the first eight hash digits."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), id_text(*ids))), 1, 8)
    return F.pmod(F.conv(digits, 16, 10).cast("bigint"), F.lit(buckets).cast("bigint"))


def hash_split(*ids: Column | str, seed: int = SEED) -> Column:
    """Bucket 0 of 10 is test, bucket 1 is dev, the other eight are train."""
    bucket = hash_bucket(*ids, buckets=10, seed=seed)
    return F.when(bucket == 0, "test").when(bucket == 1, "dev").otherwise("train")
