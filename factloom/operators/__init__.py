"""Relational, graph and ranking operators over fact tables."""
