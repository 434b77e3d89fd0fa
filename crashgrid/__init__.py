"""Road-accident map analytics as Spark DataFrame functions."""
