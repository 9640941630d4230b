"""Training-data operators: dedup, decontamination, formatting, scoring, packing, search.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries
only when it is present.
"""
