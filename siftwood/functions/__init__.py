"""Column functions: URLs, text, dates and page signals. All are native expressions."""
