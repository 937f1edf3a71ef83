"""Column functions: native text, hashing, dates, arrays, vectors; Arrow UDFs for markup."""
