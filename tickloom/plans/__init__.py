"""Declarative views compiled to one DataFrame."""
