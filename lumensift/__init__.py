"""lumensift: findings analytics over text and source collections, on Spark."""
