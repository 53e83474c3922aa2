"""weftline: analytics over schema-described entity data, built on PySpark DataFrames."""
