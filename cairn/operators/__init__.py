"""Operators over search traces, training pairs and embeddings."""
