"""Parameters of an evaluation run, with their default values."""

from __future__ import annotations

from dataclasses import dataclass

from turnwise.functions import fixed


@dataclass(frozen=True)
class Settings:
    min_turns: int = fixed.MIN_TURNS
    train_ratio: float = fixed.TRAIN_RATIO
    val_ratio: float = fixed.VAL_RATIO
    seed: int = fixed.SEED
    truncation_tokens: int = fixed.TRUNCATION_TOKENS
    n_samples: int = fixed.N_SAMPLES
    qa_per_conv: int = fixed.QA_PER_CONV
    max_retries: int = fixed.MAX_RETRIES
    vector_size: int = fixed.VECTOR_SIZE
    window: int = fixed.WINDOW
    min_count: int = fixed.MIN_COUNT
    epochs: int = fixed.EPOCHS
    train_partitions: int | None = None  # by the number of sentences
