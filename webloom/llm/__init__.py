"""Training-data pipeline operators: de-duplication, filters, tokens, shards, archives.

Nothing else in the library imports this subpackage.
"""
