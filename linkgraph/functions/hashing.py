"""Deterministic per-pair draws.

The reference samples with unseeded `math.random`, so every action redraws.
Here a draw is a pure function of the pair key: recomputing a lost partition
gives the same rows, the filter can be pushed below joins, and the same
number comes out of DuckDB for the oracle.

    x   = (p1 mod M) * A_s + (p2 mod M) * B_s + 97 s   (mod M)
    u_s = (x ** 5 mod M) / M

M is the prime 2**31 - 1; the multipliers A_s, B_s belong to the salt, so the
draws of two salts are different functions of both ids, not of one common
residue.  x ** 5 permutes the residues (5 is prime to M - 1) and breaks the
linear structure.  Ids are reduced first and every product is reduced before
the next one, so no BIGINT id overflows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the draw (shared with the SQL oracle).
HASH_MOD = 2147483647
HASH_G = 48271
HASH_SALT = 97


def salt_multipliers(salt: int) -> tuple[int, int]:
    return pow(HASH_G, 101 * salt + 1, HASH_MOD), pow(HASH_G, 211 * salt + 7, HASH_MOD)


def hash_unit(p1, p2, salt: int) -> Column:
    """u in [0, 1) for the pair (p1, p2) and the given salt."""
    a, b = salt_multipliers(salt)
    m = F.lit(HASH_MOD)

    def reduced(p, by: int) -> Column:
        p = F.col(p) if isinstance(p, str) else p
        return F.pmod(F.pmod(p.cast("bigint"), m) * F.lit(by), m)

    x = F.pmod(reduced(p1, a) + reduced(p2, b) + F.lit(HASH_SALT * salt), m)
    x2 = F.pmod(x * x, m)
    return F.pmod(F.pmod(x2 * x2, m) * x, m).cast("double") / F.lit(float(HASH_MOD))


def hash_unit_sql(p1: str, p2: str, salt: int) -> str:
    a, b = salt_multipliers(salt)
    m = HASH_MOD

    def reduced(p: str, by: int) -> str:
        return f"((((CAST({p} AS BIGINT) % {m}) + {m}) % {m}) * {by}) % {m}"

    x = f"(({reduced(p1, a)} + {reduced(p2, b)} + {HASH_SALT * salt}) % {m})"
    x2 = f"({x} * {x} % {m})"
    return f"(({x2} * {x2} % {m}) * {x} % {m} / {float(m)})"
