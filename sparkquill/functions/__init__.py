"""Column functions: text analysis, scores, dates."""
