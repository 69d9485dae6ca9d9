"""Column functions: native expressions, no Python at run time."""
