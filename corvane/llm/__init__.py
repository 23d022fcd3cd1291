"""Operations of a training-data pipeline: deduplication, search, formatting, filtering and packing."""
