"""Training-data operators: token files, packing, private data, secrets,
near-duplicates, quality, nearest neighbours, encoding, toxicity, language.

Nothing else in the library imports this subpackage.
"""
