"""Column functions: text, amounts, question rewriting. All are built-in expressions."""
