"""SQL functions and Column helpers."""
