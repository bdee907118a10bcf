"""Keep tables and text corpora in step with Spark: diff, sync, version, classify, edit, publish.

Every operator takes DataFrames and column names and returns a DataFrame; nothing is computed on the
driver and no Python runs per row.
"""
