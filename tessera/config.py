"""What a search asks for, and how an index is laid out."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum


class DistanceType(Enum):
    L2_SQUARED = "l2"
    DTW = "dtw"


class QueryType(Enum):
    TOP_K = "top_k"
    RANGE = "range"


@dataclass(frozen=True)
class SearchConfig:
    """``k`` for TOP_K, ``r`` (inclusive, on squared distances) for RANGE; ``band`` None is a tenth of the length for DTW."""

    k: int = 0
    r: float = float("inf")
    type: QueryType = QueryType.TOP_K
    distance: DistanceType = DistanceType.L2_SQUARED
    band: int | None = None

    def check(self) -> None:
        if self.type is QueryType.TOP_K and self.k < 1:
            raise ValueError("k must be at least 1")
        if self.type is QueryType.RANGE and not self.r >= 0:
            raise ValueError("r must be a number and not negative")
        if self.band is not None and self.band < 0:
            raise ValueError("band must not be negative")

    def band_for(self, dim: int) -> int:
        return max(1, dim // 10) if self.band is None else self.band


@dataclass(frozen=True)
class Layout:
    """``normalized`` series get Gaussian breakpoints, others equal-depth ones learned from ``sample`` rows."""

    segments: int = 16
    bits: int = 8
    leaf_size: int = 2000
    normalized: bool = False
    sample: int = 100_000
    word_length: int = 16
    alphabet_bits: int = 3
    equal_depth_bins: bool = False
    skip_mean: bool = False
    split_segments: int = 4

    def check(self, dim: int, strategy: str) -> None:
        if strategy != "sfa" and not 1 <= self.segments <= dim:
            raise ValueError(f"segments must be from 1 to {dim}")
        if not 1 <= self.bits <= 8 or not 1 <= self.alphabet_bits <= 8:
            raise ValueError("bits must be from 1 to 8")
        if strategy == "sfa" and not 1 <= self.word_length <= dim:
            raise ValueError(f"word_length must be from 1 to {dim}")
