"""Rule-based similarity joins and large-scale record preparation on PySpark DataFrames."""
