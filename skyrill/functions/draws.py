"""Random numbers as columns: a number of each key and seed, whatever the partitioning, that SQL engines share.

The generator is counter-based: the MD5 of key, seed and counter gives 52 bits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 52


def uniform(key: Column, seed: int, counter: int = 0) -> Column:
    """A number strictly between 0 and 1 for each key (as text)."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f":{seed}:{counter}")).cast("binary"))
    return (F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("double") + 0.5) / float(1 << BITS)


def normal(key: Column, seed: int, counter: int = 0) -> Column:
    """A standard normal number for each key, by Box and Muller's transformation; counters 2 k and 2 k + 1 share a radius and are independent."""
    pair = counter // 2 * 2
    turn = 2 * math.pi * uniform(key, seed, pair + 1)
    return F.sqrt(-2.0 * F.log(uniform(key, seed, pair))) * (F.sin(turn) if counter % 2 else F.cos(turn))


def uniform_sql(key: str, seed: int, counter: int = 0) -> str:
    """``uniform`` in the dialect of DuckDB."""
    return f"((('0x' || md5({key}::VARCHAR || ':{seed}:{counter}')[1:{BITS // 4}])::BIGINT + 0.5) / {float(1 << BITS)!r})"


def normal_sql(key: str, seed: int, counter: int = 0) -> str:
    pair = counter // 2 * 2
    return f"(sqrt(-2.0 * ln({uniform_sql(key, seed, pair)})) * {'sin' if counter % 2 else 'cos'}({2 * math.pi!r} * {uniform_sql(key, seed, pair + 1)}))"
