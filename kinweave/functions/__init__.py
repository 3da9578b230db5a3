"""Scalar functions: similarities, encoders, hashes, quality measures."""
