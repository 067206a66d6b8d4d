"""Sources of the ownership-network engine."""
