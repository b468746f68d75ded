"""Composed pipelines and extension points."""
