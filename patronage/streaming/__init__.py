"""Summaries kept current while purchases arrive."""
