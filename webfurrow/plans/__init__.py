"""Whole steps composed of the operators."""
