"""Training-data operators: filtering, deduplication, decontamination, tagging and packing of text corpora.

Nothing else in the package imports this one.  ``queries.py`` registers each operator over the shared tables.
"""
