"""Operations of a training-data pipeline: dedup, PII, fingerprints, toxicity, media, packing, language, mixing."""
