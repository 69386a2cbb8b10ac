"""Registered queries and the specification compiler."""
