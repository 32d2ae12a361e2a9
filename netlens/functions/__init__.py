"""Column functions: names and codes, scalar projections, histogram percentiles."""
