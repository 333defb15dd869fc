"""Operators on text and event sequences for training data; nothing else in the library imports them."""
