"""Training-data operators: one module an operator, nothing else in the library imports this subpackage."""
