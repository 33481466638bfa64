"""Registered queries over the driver's tables, with DuckDB SQL."""
