"""labelops: text-label dataset cleaning, sampling, labelling and evaluation on Spark.

Every public function takes and returns DataFrames keyed by an explicit row id,
so results never depend on row order or partitioning.
"""

__version__ = "0.1.0"
