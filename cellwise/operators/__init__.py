"""Fills, algebra, derived histograms, statistics, tests and fits over cell tables."""
