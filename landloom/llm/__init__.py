"""Operations of a training-data pipeline: deduplication, search, privacy, packing, quality, mixing.

Nothing else in the library imports this subpackage.
"""
