"""Writers: staged Parquet, feature artifacts, vector dumps, CSV / Parquet export."""
