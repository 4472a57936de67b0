"""Functions of collatio."""
