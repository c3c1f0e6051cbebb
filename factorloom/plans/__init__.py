"""Registered queries: each applies an operator to whole tables; ``SQL`` holds the same as DuckDB SQL."""
