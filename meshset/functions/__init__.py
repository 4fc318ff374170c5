"""Functions of the expression language."""
