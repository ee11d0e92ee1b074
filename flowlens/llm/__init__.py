"""Training-data operators (chat, fingerprints, tokens, WARC, filters, packing).

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries when it is present.
"""
