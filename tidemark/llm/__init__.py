"""Operations for training-data pipelines: classification, PII, extraction, mixing, counts, deduplication, chat, decontamination."""
