"""Analytics over metrics, logs and trace spans of many tenants, on Spark DataFrames."""
