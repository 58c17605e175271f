"""termforge: an updatable inverted-index and text-corpus engine expressed as Spark DataFrames."""
