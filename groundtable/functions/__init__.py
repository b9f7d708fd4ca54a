"""Column functions: text analysis, hashing, vector arithmetic."""
