"""Streaming of collatio."""
