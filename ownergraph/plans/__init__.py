"""Plans of the ownership-network engine."""
