"""cuewright: timed-text analytics expressed as Spark DataFrames."""
