"""Settings of a text memory, checked when they are made, and the search sizes that follow from them."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum
from math import ceil


class Limit(Enum):
    """Where an expanded passage stops."""

    SENTENCE = (".", "?", "!", "???", "!!!")
    LINE = ("\n", "\r\n")
    PARAGRAPH = ("\n\n", "\r\n\r\n")
    SECTION = ()


class Decay(Enum):
    EXPONENTIAL = "exponential"
    INVERSE = "inverse"


class MemoryKind(Enum):
    CONVERSATION = "convo"
    KNOWLEDGE = "kb"


class AgentVariant(Enum):
    SEMANTIC_ONLY = "semantic_only"
    QG_JSON_USER_INFO = "qg_json_user_info"
    TEXT_SCRATCHPAD = "text_scratchpad"


@dataclass(frozen=True)
class Expansion:
    """Tokens to add on each side of a chunk: `least` always, up to `most` until a stop."""

    least: int = 0
    most: int = 24
    limit: Limit = Limit.SENTENCE

    def __post_init__(self) -> None:
        if self.most < self.least:
            raise ValueError("most side tokens are fewer than least")

    @classmethod
    def for_sentence(cls, least: int = 0, most: int = 24) -> Expansion:
        return cls(least, most, Limit.SENTENCE)

    @classmethod
    def for_line_break(cls, least: int = 16, most: int = 64) -> Expansion:
        return cls(least, most, Limit.LINE)

    @classmethod
    def for_paragraph(cls, least: int = 0, most: int = 192) -> Expansion:
        return cls(least, most, Limit.PARAGRAPH)

    @classmethod
    def for_section(cls, least: int = 0, most: int = 1024) -> Expansion:
        return cls(least, most, Limit.SECTION)

    @classmethod
    def for_chunk(cls) -> Expansion:
        return cls(0, 0, Limit.SECTION)


@dataclass(frozen=True)
class MemoryConfig:
    """A memory's layout and retrieval settings."""

    capacity: int = 24
    queue: int = 50_000
    overlap: float = 0.5
    threshold: float = 0.75
    rerank_factor: float = 10.0
    max_query_tokens: int = 40
    expansion: Expansion = field(default_factory=Expansion)
    max_factor: float = 200.0

    def __post_init__(self) -> None:
        if not 0 <= self.overlap <= 0.5:
            raise ValueError(f"overlap {self.overlap} is not in [0, 0.5]")
        if not 0 < self.threshold <= 1:
            raise ValueError(f"threshold {self.threshold} is not in (0, 1]")
        if self.rerank_factor < 1:
            raise ValueError("rerank factor is below 1")
        check_layout(self.queue, self.capacity, self.stride)
        if self.search_factor > self.max_factor:
            raise ValueError("the expansion needs too many chunks: raise capacity or threshold, or expand less")

    @property
    def stride(self) -> int:
        return self.capacity - ceil(self.capacity * self.overlap)

    @property
    def search_factor(self) -> float:
        """Chunks to look at for each passage wanted, since overlapping ones fall away."""
        reach = (2 * self.expansion.most / self.capacity + 2) / (1 - self.overlap)
        return self.threshold + (1 - self.threshold) * (1 + reach)

    def sizes(self, k: int, reranks: bool = False, slots: int = 1) -> tuple[int, int, int]:
        """Passages to rerank, chunks to expand and vectors to find for k results."""
        if k <= 0:
            raise ValueError("k is not positive")
        rerank = round(k * self.rerank_factor) if reranks else k
        expand = 1 + ceil((rerank - 1) * self.search_factor)
        return rerank, expand, 1 + (expand - 1) * slots


def check_layout(queue: int, capacity: int, stride: int) -> None:
    if queue < 3:
        raise ValueError("a queue holds at least 3 chunks")
    if capacity < 1:
        raise ValueError("a chunk holds at least one token")
    if stride < capacity // 2 or stride > capacity:
        raise ValueError("the stride is less than half a chunk, or more than one")
