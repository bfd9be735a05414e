"""Operators that prepare text collections for training; nothing outside this folder imports it."""
