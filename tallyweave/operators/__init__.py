"""Relational operators: duplicate layers, matching phases, classification, reports."""
