"""Readers of fact tables and views that bind them."""
