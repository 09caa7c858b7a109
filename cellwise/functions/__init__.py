"""Binning expressions and special functions."""
