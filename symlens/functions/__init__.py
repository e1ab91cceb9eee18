"""Column expressions, schemas and configuration."""
