"""Training-data operators: one module for each, `queries` registers them."""
