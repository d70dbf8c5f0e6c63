"""Functions over columns: native expressions and Arrow-batched codecs."""
