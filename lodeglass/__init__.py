"""lodeglass: Spark-native analytics over source trees, logs and free text.

Every operator takes and returns DataFrames, orders explicitly, and takes the
current time as an argument where it needs one.
"""
