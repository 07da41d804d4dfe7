"""Pure Column expressions."""
