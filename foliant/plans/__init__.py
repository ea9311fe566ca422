"""Domain views over tables, and the queries on them."""
