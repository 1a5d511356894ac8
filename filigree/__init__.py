"""Rare patterns in graphs, as DataFrame operators."""
