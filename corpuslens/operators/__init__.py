"""Relational and graph operators of the scanner, all as DataFrame transformations."""
