"""DataFrame-to-DataFrame operators. Each takes tables and column names, never table names."""
