"""Relational operators over the tables of a document collection; built-in functions only unless a module says otherwise."""
