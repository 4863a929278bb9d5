"""Position search in a sorted array column without lambdas.

Higher-order functions run interpreted, once per array element. The search below is a chain
of seven projections (64, 32, .. 1) that whole-stage code generation compiles, and needs
log2 steps per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Seven steps cover up to 127 elements. A monthly distribution has at most two entries more
# than it has classes, ceil(1 + 3.322*log10(n)) <= 65 for every n below 2**63.
_STEPS = (64, 32, 16, 8, 4, 2, 1)
MAX_LENGTH = 2 * _STEPS[0] - 1


def count_below(df: DataFrame, array: str, probe: str, out: str, inclusive: bool) -> DataFrame:
    """Add ``out``: how many elements of the ascending ``array`` are < (or <=) ``probe``."""
    df = df.withColumn(out, F.lit(0))
    for step in _STEPS:
        element: Column = F.get(F.col(array), F.col(out) + F.lit(step - 1))
        passed = element <= F.col(probe) if inclusive else element < F.col(probe)
        df = df.withColumn(out, F.col(out) + F.when(passed, F.lit(step)).otherwise(F.lit(0)))
    return df
