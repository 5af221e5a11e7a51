"""Bindings to the sample tables, the registered queries and their SQL counterparts."""
