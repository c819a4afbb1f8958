"""barframe: ordered bar series on Spark."""
