"""Seeds and ranks from hashes: the same on any number of partitions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def seed_of(*parts: object) -> int:
    """The first eight bytes, big-endian, of SHA-256 over the parts joined by ``|``."""
    return int.from_bytes(hashlib.sha256("|".join(map(str, parts)).encode()).digest()[:8], "big")


def seed_column(*parts: Column) -> Column:
    """``seed_of`` as decimal(20)."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def hash_rank(*parts: Column) -> Column:
    """An order that looks random: SHA-256 of the parts joined by ``|``, as hex."""
    return F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256)


def slot(*parts: Column, n: int = 4) -> Column:
    """An even choice of 0..n-1 for each key."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts))), 1, 15), 16, 10).cast("long"), F.lit(n)).cast("int")


def numpy_permutation(seed: int, n: int) -> list[int]:
    """Bit for bit the permutation of NumPy's default generator; on the driver, for small n."""
    import numpy as np

    return np.random.default_rng(seed).permutation(n).tolist()
