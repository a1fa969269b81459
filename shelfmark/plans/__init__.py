"""Whole batch jobs composed of functions and operators."""
