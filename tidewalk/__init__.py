"""Grid-section analytics with PySpark DataFrames."""
