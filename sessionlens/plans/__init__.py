"""Runs that share intermediate tables between operators."""
