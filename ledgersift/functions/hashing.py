"""Seeded randomness as a pure function of the row key.

A row's draw depends on (seed, tag, key) only, so it survives recomputation,
repartitioning and lost executors, and any SQL engine with md5 can repeat it.
"""

from __future__ import annotations

import random

from pyspark.sql import Column
from pyspark.sql import functions as F

UINT32 = 4294967296


def hash_hex(seed: int, tag: str, *key: Column | str) -> Column:
    parts = [F.lit(str(seed)), F.lit(tag)]
    parts += [(F.col(k) if isinstance(k, str) else k).cast("string") for k in key]
    return F.md5(F.concat_ws(":", *parts).cast("binary"))


def hash_uint32(hex_hash: Column) -> Column:
    """First eight hex digits as 1..2^32."""
    return F.conv(F.substring(hex_hash, 1, 8), 16, 10).cast("long") + F.lit(1)


def uniform(seed: int, tag: str, *key: Column | str) -> Column:
    """Uniform draw in (0, 1]."""
    return hash_uint32(hash_hex(seed, tag, *key)) / F.lit(float(UINT32))


def seed_draw() -> int:
    """Seed used when the caller gives none."""
    return random.SystemRandom().randint(1, 10000)
