"""Operators of collatio."""
