"""Continuous arrival of feeds."""
