"""Registered queries with their SQL twins, and plan-level helpers."""
