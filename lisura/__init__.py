"""Public-purchasing analytics as Spark table jobs.

Every job takes DataFrames and returns a DataFrame.  Nothing in the library
calls ``collect`` on data, caches on local disk or opens a connection; actions
happen only where a table is written.
"""
