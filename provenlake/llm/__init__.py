"""Training-data operators: tokenising, near-duplicate removal, search, language models, WARC and packing.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its queries when it is there.
"""
