"""Data-parallel pipelines over typed collections and key/value tables, planned by Catalyst."""
