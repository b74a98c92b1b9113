"""Column functions: tokens, numbers, dates, stemming."""
