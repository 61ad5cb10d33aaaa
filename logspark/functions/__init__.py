"""Column functions: everything here stays inside generated code."""
