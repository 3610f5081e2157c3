"""Column builders. Each takes Columns and returns a Column built from Spark functions only."""
