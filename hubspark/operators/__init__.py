"""Relational operators on graphs, partitions and their scores."""
