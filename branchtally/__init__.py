"""branchtally: branch reports from messy delimited extracts, as Spark DataFrame plans.

Layout
------
functions   column expressions (trim, canonical keys, numbers, rounding)
sources     text lines, header discovery, extracts, reference tables, sinks
operators   DataFrame -> DataFrame building blocks (filters, lookups, sums, ...)
plans       report specifications and the plans that compose the operators
driver      the queries of ``__spark_entry__.py`` with their SQL oracles
"""
