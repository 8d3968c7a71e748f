"""Security-investigation analytics over decoded evidence tables, on Spark."""
