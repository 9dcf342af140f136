"""Dataset operators over catalogs and DataFrames."""
