"""Operators for language-model data: runs of events, packing, leaked test passages, splitting. Nothing else in the library imports this."""
