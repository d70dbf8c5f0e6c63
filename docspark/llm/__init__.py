"""Training-data operators: search, tokens, chat text, deduplication, quality, privacy, toxicity and mixing.

Nothing else in the library imports this subpackage.
"""
