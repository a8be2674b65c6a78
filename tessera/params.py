"""Parameters of all operators in one place, with their defaults and allowed ranges."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Params:
    tokens_per_char: float = 0.25
    context_limit: int = 100_000
    chunk_tokens: int = 1000
    chunk_overlap_lines: int = 5
    max_file_size_kb: int = 500
    binary_check_bytes: int = 1024
    minified_line_length: int = 500
    max_context_tokens: int = 6000
    max_result_tokens: int = 1500
    high_confidence: float = 0.3
    medium_confidence: float = 0.6
    strong_match: float = 0.5
    min_strong_matches: int = 3
    graph_hops: int = 2
    graph_confidence: float = 0.5
    diagram_token_budget: int = 500
    gap_passes: int = 3
    session_ttl_minutes: int = 30
    session_max_nodes: int = 50
    gap_top_k: int = 3
    result_limit: int = 10
    snippet_max_length: int = 200
    dedup_length: int = 500
    rrf_k: int = 60
    missing_rank: int = 1000
    wiki_dir: str = ".wiki"


#: Allowed (least, most) of the numeric parameters; None is open.
RANGES: dict[str, tuple[float, float | None]] = {
    "tokens_per_char": (0.1, 1.0), "context_limit": (1000, None), "chunk_tokens": (100, 10_000), "chunk_overlap_lines": (0, 50),
    "max_file_size_kb": (1, 10_000), "binary_check_bytes": (64, 8192), "minified_line_length": (100, 5000), "max_context_tokens": (500, 50_000),
    "max_result_tokens": (100, 10_000), "high_confidence": (0, 1), "medium_confidence": (0, 1), "strong_match": (0, 1), "min_strong_matches": (1, 20),
    "graph_hops": (0, 5), "graph_confidence": (0, 1), "diagram_token_budget": (100, 2000), "gap_passes": (1, 10), "session_ttl_minutes": (5, 120),
    "session_max_nodes": (10, 200), "gap_top_k": (1, 20), "result_limit": (1, 100), "snippet_max_length": (50, 1000), "dedup_length": (100, 2000),
}
DEFAULT = Params()


def checked(params: Params) -> Params:
    """params, if every number is in its range; else ValueError."""
    for name, (least, most) in RANGES.items():
        value = getattr(params, name)
        if value < least or most is not None and value > most:
            raise ValueError(f"{name} = {value} is not in [{least}, {'' if most is None else most}]")
    return params


def from_env(prefix: str = "TESSERA_", env: dict[str, str] | None = None) -> Params:
    """Defaults, overridden by variables such as TESSERA_RESULT_LIMIT, cast to each parameter's type and checked."""
    env = dict(os.environ) if env is None else env
    found = {f.name: type(getattr(DEFAULT, f.name))(env[prefix + f.name.upper()]) for f in fields(Params) if prefix + f.name.upper() in env}
    return checked(replace(DEFAULT, **found))
