"""Functions of the ownership-network engine."""
