"""Training-data operators: quality, media, packing, deduplication, decontamination, archives.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries when it is present.
"""
