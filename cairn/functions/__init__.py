"""Column functions for proof states, tactics and vectors."""
