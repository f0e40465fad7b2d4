"""Relation-mask expressions.

A mask is an integer whose low 21 bits flag relation types; 0 = unlabelled.
Positions are 1-based from the low bit, with position 0 standing for "no
bit set".  A pair of positions (lo <= hi) in 0..21 maps one to one onto a
cell 0..252 by  cell(lo, hi) = hi + 22*lo - lo*(lo+1)/2.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK_BITS = 21            # low bits that carry relation types
N_POSITIONS = MASK_BITS + 1
N_CELLS = 253             # cells 0..252; cell 0 = both ends unlabelled


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def mask_bits(mask) -> Column:
    """ARRAY<INT> of 21 digits, most significant first (index 20 = bit 0)."""
    m = _c(mask)
    return F.transform(F.sequence(F.lit(MASK_BITS - 1), F.lit(0), F.lit(-1)),
                       lambda b: F.getbit(m, b).cast("int"))


def mask_bits_string(mask) -> Column:
    return F.array_join(mask_bits(mask), "")


def mask_positions(mask) -> Column:
    """Set bit positions 1..21 (from the low bit), or [0] when none is set."""
    m = _c(mask)
    pos = F.filter(F.sequence(F.lit(1), F.lit(MASK_BITS)),
                   lambda i: F.getbit(m, i - 1) == 1)
    return F.when(F.size(pos) == 0, F.array(F.lit(0))).otherwise(pos)


def cell_index(lo, hi) -> Column:
    lo, hi = _c(lo), _c(hi)
    return hi + F.lit(N_POSITIONS) * lo - (lo * (lo + 1)) / 2


def pair_cells(mask1, mask2) -> Column:
    """Distinct cells set by a pair of masks (set, not add)."""
    a, b = mask_positions(mask1), mask_positions(mask2)

    def cell(i, j):
        lo, hi = F.least(i, j), F.greatest(i, j)
        return (hi + F.lit(N_POSITIONS) * lo - F.floor(lo * (lo + 1) / 2)).cast("int")

    return F.array_distinct(F.flatten(F.transform(a, lambda i: F.transform(b, lambda j: cell(i, j)))))


def diagonal_cell(i, offset: int = 1) -> Column:
    """Cell read for relation type i (0..20).  The reference reads the
    histogram after dropping cell 0, so its index i lands on cell (i, i+1):
    offset 1 reproduces that, offset 0 reads the diagonal (i, i)."""
    i = _c(i)
    return (i + offset + F.lit(N_POSITIONS) * i - F.floor(i * (i + 1) / 2)).cast("int")
