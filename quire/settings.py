"""Limits and switches of the document engine, as one immutable record."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    max_file_size_mb: int = 10
    max_pages: int = 10
    batch_max_pages: int = 100
    batch_mode: bool = False
    batch_size: int = 5
    mock_translation: bool = True
    llm_timeout_seconds: int = 30
    llm_retries: int = 1
    overlay_padding: float = 1.5
    semantic_threshold: float = 0.45
    #: Count table cells in both of their nested forms, as one literal reading of stored documents does.
    literal_grid_parity: bool = False
    #: Let blocks count as contained in longer blocks of their section.
    section_containment: bool = False

    @classmethod
    def from_environment(cls, prefix: str = "QUIRE_") -> Settings:
        """Settings from variables such as QUIRE_BATCH_SIZE."""
        found = {}
        for f in fields(cls):
            raw = os.environ.get(prefix + f.name.upper())
            if raw is not None:
                kind = type(f.default)
                found[f.name] = raw.lower() in ("1", "true", "yes") if kind is bool else kind(raw)
        return cls(**found)
