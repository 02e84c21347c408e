"""Parameters of candidate generation."""

from __future__ import annotations

from dataclasses import dataclass

#: The usual short English list of search engines. A parameter, as every list of this kind.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not",
    "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
)


@dataclass(frozen=True)
class BlockingConfig:
    """top_k matches are kept per record and target source. Sources are numbered 0, 1, 2."""

    top_k: int = 7
    include_s2_s3: bool = True
    k1: float = 1.5
    b: float = 0.75
    max_df_ratio: float | None = None
    ngram_range: tuple[int, int] = (2, 4)
    upper_threshold: int = 15_000
    lower_threshold: int = 50
    joint_thresholds: bool = True
    suffix_address: bool = False
    stopwords: tuple[str, ...] = STOPWORDS

    @property
    def jobs(self) -> tuple[tuple[int, int], ...]:
        """(query source, target source)."""
        return ((0, 1), (0, 2), (1, 2)) if self.include_s2_s3 else ((0, 1), (0, 2))
