"""Readers and writers of graphs and result bundles."""
