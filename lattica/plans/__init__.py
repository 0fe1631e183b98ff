"""Graph algorithms composed from the operators."""
