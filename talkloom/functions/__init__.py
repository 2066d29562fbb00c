"""Column functions with the semantics the operators need."""
