"""From the typed tree to query blocks, SQL text and DataFrames."""
