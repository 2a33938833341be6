"""The catalogue of queries and their oracle SQL."""
