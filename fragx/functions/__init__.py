"""Column expressions: they never shuffle and stay inside code generation."""
