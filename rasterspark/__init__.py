"""rasterspark: image-asset analytics expressed as Spark DataFrames."""
