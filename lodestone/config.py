"""Settings with their defaults; a JSON file and environment variables override them."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields, is_dataclass, replace


@dataclass(frozen=True)
class Budget:
    """Sizes of chunks in tokens, and which optional header lines are written."""

    min_tokens: int = 40
    target_tokens: int = 500
    max_tokens: int = 700
    header_budget: int = 120
    module_doc: bool = True
    class_doc: bool = False
    path_words: bool = True
    imports: bool = True
    exports: bool = True
    callers: bool = False


@dataclass(frozen=True)
class Penalty:
    glob: str
    weight: float


#: Path penalties, multiplied when several match.
PENALTIES = (
    Penalty("**/*.test.*", 0.4),
    Penalty("**/*.spec.*", 0.4),
    Penalty("**/test/**", 0.5),
    Penalty("**/tests/**", 0.5),
    Penalty("**/__tests__/**", 0.5),
    Penalty("**/__mocks__/**", 0.4),
    Penalty("**/fixtures/**", 0.4),
    Penalty("**/examples/**", 0.6),
)


@dataclass(frozen=True)
class Rerank:
    enabled: bool = True
    candidates: int = 20
    fusion: str = "rrf"
    weight: float = 0.5
    strict: bool = False


@dataclass(frozen=True)
class Search:
    top_k: int = 8
    mode: str = "semantic"
    candidates: int = 50
    rrf_k: int = 60
    max_per_file: int = 2
    token_budget: int = 4000
    vector_weight: float = 1.0
    lexical_weight: float = 0.5
    file_card_prior: float = 0.6
    unnamed_prior: float = 0.7
    doc_prior: float = 0.7
    deleted_prior: float = 0.5
    include_deleted: bool = False
    rerank: Rerank = field(default_factory=Rerank)
    penalties: tuple[Penalty, ...] = PENALTIES


@dataclass(frozen=True)
class Config:
    dims: int = 768
    budget: Budget = field(default_factory=Budget)
    search: Search = field(default_factory=Search)


def _merge(base, given: dict):
    known = {f.name: getattr(base, f.name) for f in fields(base)}
    if unknown := set(given) - set(known):
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return replace(base, **{k: _merge(known[k], v) if is_dataclass(known[k]) else v for k, v in given.items()})


def load(path: str | None = None, env: dict[str, str] | None = None) -> Config:
    """Defaults, then the JSON file, then LODESTONE_SECTION_NAME variables (JSON values)."""
    config = Config()
    if path:
        with open(path, encoding="utf-8") as f:
            config = _merge(config, json.load(f))
    for key, value in (os.environ if env is None else env).items():
        if key.startswith("LODESTONE_"):
            section, _, name = key.removeprefix("LODESTONE_").lower().partition("_")
            config = _merge(config, {section: {name: json.loads(value)}} if name else {section: json.loads(value)})
    return config
