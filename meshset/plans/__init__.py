"""Lexer, parser and planner of the expression language."""
