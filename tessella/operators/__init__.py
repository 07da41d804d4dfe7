"""Relational and iterative operators, DataFrame in and DataFrame out."""
