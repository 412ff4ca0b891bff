"""nearfield: continuous distance-based outlier analytics on PySpark."""
