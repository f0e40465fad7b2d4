"""linkgraph: link prediction and recommendation over large social graphs,
expressed as Spark DataFrame / Spark SQL / Spark ML plans.

Every public function takes DataFrames and returns a lazily evaluated
DataFrame, so Catalyst sees the whole plan (pruning, pushdown, join choice,
partial aggregation) and AQE re-plans it at run time.
"""

from linkgraph.config import Params

__all__ = ["Params"]
__version__ = "0.1.0"
