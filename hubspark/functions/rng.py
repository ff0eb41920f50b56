"""Counter-based randomness: a hash of seed and keys, the same on any partitioning, in SQL and in Python."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def coin(seed: int | str, *keys: Column | str) -> Column:
    """Uniform integer below 2**32 from the md5 of ``seed|key|key...``."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    text = F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def uniform(seed: int | str, *keys: Column | str) -> Column:
    return coin(seed, *keys) / F.lit(2.0**32)


def coin_of(seed: int | str, *keys) -> int:
    """The same in Python."""
    return int(hashlib.md5("|".join(map(str, (seed, *keys))).encode()).hexdigest()[:8], 16)


def uniform_of(seed: int | str, *keys) -> float:
    return coin_of(seed, *keys) / 2.0**32
