"""Apply fitted steps to files as they arrive."""
