"""Column functions: text, dates, check digits, tax arithmetic, untyped JSON values."""
