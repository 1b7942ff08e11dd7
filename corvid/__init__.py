"""corvid: contract discovery and relational kernels as PySpark DataFrames."""
