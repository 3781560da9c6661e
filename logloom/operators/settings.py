"""The settings of a search, checked before it runs."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class SearchSettings:
    """Budgets in bytes, calls and tokens, shares from 0 to 1, the directory's fan-out, and switches (0 or 1) that leave parts out."""

    span_bytes: int = 2200
    segment_bytes: int = 32000
    segment_records: int = 64
    evidence_bytes: int = 10000
    request_bytes: int = 62000
    max_calls: int = 64
    max_request_bytes: int = 1_600_000
    max_input_tokens: int = 300_000
    max_rounds: int = 24
    max_hops: int = 4
    selection_mass: float = 0.9
    decision_threshold: float = 0.8
    diversity_percent: int = 70
    directory_fanout: int = 6
    reserve_calls: int = 2
    reserve_request_bytes: int = 130_000
    final_request_bytes: int = 62000
    global_retrieval: int = 1
    iterative_queries: int = 1
    factored_verification: int = 1

    SHARES = ("selection_mass", "decision_threshold")
    SWITCHES = ("global_retrieval", "iterative_queries", "factored_verification")

    def faults(self) -> list[str]:
        """What is wrong, one entry a setting or rule; empty if nothing is."""
        out = []
        for name, value in asdict(self).items():
            if name in self.SWITCHES:
                out += [] if type(value) is int and value in (0, 1) else [name]
            elif isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value) or value <= 0:
                out.append(name)
            elif name in self.SHARES:
                out += [] if value <= 1 else [name]
            elif type(value) is not int:
                out.append(name)
        if out:
            return out
        rules = {
            "diversity_percent": self.diversity_percent <= 100,
            "directory_fanout": 2 <= self.directory_fanout <= 12,
            "evidence_bytes": self.evidence_bytes >= 2 * self.span_bytes + 800,
            "segment_records": self.segment_records <= 250,
            "reserve_calls": self.reserve_calls >= 2,
            "reserve_request_bytes": self.reserve_request_bytes >= 2 * min(self.final_request_bytes, self.request_bytes),
        }
        return [name for name, holds in rules.items() if not holds]

    def checked(self) -> SearchSettings:
        if faults := self.faults():
            raise ValueError(f"invalid settings: {', '.join(faults)}")
        return self
