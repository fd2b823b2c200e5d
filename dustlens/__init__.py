"""Inspecting, querying and extracting the contents of old binary files with Spark."""
