"""Detection rules: their language, loading, checking and inheritance."""
