"""Histograms filled from streams."""
