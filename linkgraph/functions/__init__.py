"""Column expressions (JVM side, codegen friendly).  No Python UDFs."""

from linkgraph.functions.hashing import hash_unit
from linkgraph.functions.masks import (
    MASK_BITS, mask_bits, mask_bits_string, mask_positions, pair_cells, cell_index,
)

__all__ = ["hash_unit", "MASK_BITS", "mask_bits", "mask_bits_string",
           "mask_positions", "pair_cells", "cell_index"]
