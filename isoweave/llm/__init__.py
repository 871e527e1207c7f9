"""Training-data operators: one module for each operator, queries in `queries`."""
