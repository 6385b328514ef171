"""Scans, sinks, stored state and the listing view."""
