"""Column helpers and small job utilities shared by the operators."""
