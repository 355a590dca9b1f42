"""Parameters of the jobs, clamped to their ranges."""

from __future__ import annotations

from dataclasses import dataclass

# fixed values: default, least, most
RANGES = {
    "window_size": (10, 0, 1000),
    "turns_per_chunk": (10, 1, 100),
    "group_1": (10, 2, 100),
    "group_n": (5, 2, 100),
    "tokens_1": (3000, 128, 16000),
    "tokens_n": (8000, 512, 16000),
    "keyword_entries": (20, 0, 100),
    "chunk_chars": (100_000, 1_000, 10_000_000),
    "stored_chars": (64_000, 1, 64_000),
    "entry_chars": (50_000, 1, 50_000),
    "carried_chars": (5_000, 1, 5_000),
}


@dataclass(frozen=True)
class Params:
    window_size: int = 10
    window_unit: str = "turns"  # or "messages"
    turns_per_chunk: int = 10
    group_1: int = 10
    group_n: int = 5
    tokens_1: int = 3000
    tokens_n: int = 8000
    keyword_entries: int = 20
    chunk_chars: int = 100_000
    stored_chars: int = 64_000
    entry_chars: int = 50_000
    carried_chars: int = 5_000

    def __post_init__(self) -> None:
        for name, (default, least, most) in RANGES.items():
            value = getattr(self, name)
            value = default if not isinstance(value, (int, float)) or isinstance(value, bool) or value != value else int(value)
            object.__setattr__(self, name, min(most, max(least, value)))
        if self.window_unit not in ("turns", "messages"):
            object.__setattr__(self, "window_unit", "turns")
