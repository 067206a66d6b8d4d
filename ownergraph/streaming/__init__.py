"""Streaming of the ownership-network engine."""
