"""Stateful queries: quotas, claims, sessions, partial-hypothesis commit."""
