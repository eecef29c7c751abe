"""Operators for preparing language-model training data. Nothing else in framelake imports this."""
