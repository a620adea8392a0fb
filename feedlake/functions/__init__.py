"""Column helpers: text, dates and URLs, all made of built-in expressions."""
