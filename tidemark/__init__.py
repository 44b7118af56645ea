"""tidemark: Spark jobs for observation series, task logs, evidence packs and listings.

Every public operator takes and returns DataFrames (or Columns) and stays lazy; nothing is
collected to the driver except the one-row stop tests of the iterative graph operators.
"""
