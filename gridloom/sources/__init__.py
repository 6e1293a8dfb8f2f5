"""Readers and writers.  Files are read by Spark (binaryFile), so any store that it reaches works."""
