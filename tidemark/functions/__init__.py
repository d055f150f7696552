"""Scalar functions and codecs."""
