"""Streams: incremental refresh of co-change weights and the registry."""
