"""Column functions: question rules, annotations."""
