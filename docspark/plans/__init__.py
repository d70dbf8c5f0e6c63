"""The tables of a document collection, composed of sources, functions and operators."""
