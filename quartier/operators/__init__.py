"""Distributed operators over any table whose columns the caller names."""
