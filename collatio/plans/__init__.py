"""Plans of collatio."""
