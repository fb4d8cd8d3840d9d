"""parityframe: Spark-native tabular preparation, rebalancing and
group-fairness auditing of binary classifiers.

Every operator takes and returns Spark DataFrames. Fitted state (bounds,
code maps, column lists) is small and returned as plain Python values or
small DataFrames; the heavy work stays in Catalyst plans.
"""

from parityframe.session import get_spark, ensure_checkpoint_dir

__all__ = ["get_spark", "ensure_checkpoint_dir"]
