"""Operators that prepare training text: quality, secrets, near copies, shards, mixtures, licences, repeats, pieces.

Nothing else in the package imports this folder. Each module holds one operator and its registered query.
"""
