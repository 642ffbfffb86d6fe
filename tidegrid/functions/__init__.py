"""Column-level functions: Column to Column, and driver-side name handling."""
