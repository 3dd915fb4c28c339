"""Reproducible stand-ins for random draws: arithmetic hashes of row keys, the same in any SQL engine."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values of the draw: multiplier, modulus
MULTIPLIER = 2654435761
MODULUS = 4294967296
# reduce keys below this before multiplying, so that the product stays inside 64 bits
KEY_MODULUS = 2147483648


def hash_key(*keys: Column, seed: int = 0) -> Column:
    """A 32-bit number per key tuple, well spread and order dependent."""
    return hash_further(F.lit(seed).cast("long"), *keys)


def hash_further(start: Column, *keys: Column) -> Column:
    """hash_key of longer tuples from the hash of their common beginning."""
    return reduce(
        lambda acc, key: F.pmod((acc + F.pmod(key, F.lit(KEY_MODULUS))), F.lit(KEY_MODULUS)) * MULTIPLIER % MODULUS, keys, start
    )


def hash_key_values(*keys: np.ndarray, seed: int = 0) -> np.ndarray:
    """The same number for arrays of 64-bit keys."""
    wide = [key.astype(np.int64) for key in keys]
    return reduce(lambda acc, key: (acc + key % KEY_MODULUS) % KEY_MODULUS * MULTIPLIER % MODULUS, wide, np.int64(seed))


def hash_key_sql(*keys: str, seed: int = 0) -> str:
    """The same number as a SQL expression (non-negative keys)."""
    acc = f"CAST({seed} AS BIGINT)"
    for key in keys:
        acc = f"(((({acc}) + (({key}) % {KEY_MODULUS})) % {KEY_MODULUS}) * {MULTIPLIER} % {MODULUS})"
    return acc


def unit_draw(*keys: Column, seed: int = 0) -> Column:
    """A number in [0, 1)."""
    return hash_key(*keys, seed=seed) / F.lit(float(MODULUS))
