"""Column functions: strings, dates, exact rounding and the registered function surface."""
