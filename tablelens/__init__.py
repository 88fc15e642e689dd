"""tablelens — automatic analysis of one flat table of unknown schema, on Spark.

Every stage takes a DataFrame (plus the role table and options) and returns
small result DataFrames; the heavy work runs as Spark aggregations, windows,
joins and ML jobs.  See ``tablelens.plans.analyze.analyze`` for the full run.
"""

from tablelens.options import Options

__all__ = ["Options"]
