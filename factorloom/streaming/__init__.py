"""Structured Streaming: keeping a factor store up to date as bars land."""
