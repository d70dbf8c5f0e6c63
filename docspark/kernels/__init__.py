"""Bit-level codecs and parsers in Python and NumPy; nothing here knows Spark."""
