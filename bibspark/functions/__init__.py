"""Row-level Column expressions."""
