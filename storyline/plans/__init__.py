"""Whole stages built from the operators."""
