"""Registered queries: each operator over whole tables derived from the given ones, with its ANSI SQL twin."""
