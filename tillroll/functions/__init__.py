"""Column expressions: text, numbers, dates and receipt-line rules."""
