"""Cost-domain tables derived from the benchmark tables.

Every relation is a projection of one stored table (no join), so filters and column choices
reach the Parquet scan, and each grows with the table it is derived from.
"""
