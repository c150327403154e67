"""Operations of a training-data pipeline: search, quality, decontamination, deduplication, privacy, URLs, tokens, archives."""
