"""Parameters of an assembly, with the defaults of the modelled pipeline."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    """Lengths given as None are multiples of k: tips 3k, bubbles 5k, low coverage 2k, unique contigs k."""

    k: int
    max_read_starts: int = 250
    max_threads: int = 250
    record_all_threads: bool = False
    trim5: int = 0
    trim3: int = 0
    tip_len: int | None = None
    bubble_len: int | None = None
    bubble_rate: float = 0.05
    low_cov: float = 5.0
    low_cov_len: int | None = None
    min_thread_weight: int = 5
    insert_len: int = 0
    wiggle: int = 30
    min_unique_cov: float = 0.0
    max_unique_cov: float = 0.0
    min_unique_len: int | None = None
    max_frontier: int = 10
    genome_size: int = -1

    def __post_init__(self) -> None:
        if self.k < 3 or self.k % 2 == 0:
            raise ValueError("k must be odd, so that no K-mer is its own reverse complement, and at least 3")
        if self.insert_len > 0 and self.max_unique_cov <= 0:
            raise ValueError("mate pairs need the coverage band of unique contigs")
        for name, factor in (("tip_len", 3), ("bubble_len", 5), ("low_cov_len", 2), ("min_unique_len", 1)):
            if getattr(self, name) is None:
                object.__setattr__(self, name, factor * self.k)
