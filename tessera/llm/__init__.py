"""Training-data operators: sharding, filtering, deduplication, tokenising.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries if it is there.
"""
