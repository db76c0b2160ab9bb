"""Live use of the batch operators."""
