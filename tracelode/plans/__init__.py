"""Helpers that shape physical plans: durable intermediate tables, shuffle width, skew-safe joins."""
