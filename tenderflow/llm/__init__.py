"""Operators for text corpora: cleaning, de-duplication, mixing and packing of training data."""
