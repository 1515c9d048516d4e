"""Clinical-style analytics on Spark: catalogue, time operators, concepts, quality, comparison."""

__version__ = "0.1.0"
