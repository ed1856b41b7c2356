"""Column functions: every one is a composition of built-in expressions, so plans stay inside code generation."""
