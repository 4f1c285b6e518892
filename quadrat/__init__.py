"""Quadrat: DataFrame operators for regional panels (region x time x measures) and for training corpora."""
