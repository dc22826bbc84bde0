"""Set-at-a-time news analytics on PySpark."""
