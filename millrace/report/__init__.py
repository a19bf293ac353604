"""Reports: named data sources with parameters, run together."""
