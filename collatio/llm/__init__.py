"""Operators that prepare and check training data; nothing else in the library imports them."""
