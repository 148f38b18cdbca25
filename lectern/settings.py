"""Settings: the environment before a file before defaults, with their types, limits and older names."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path

TRUE = {"1", "true", "yes", "on"}
# Older names of settings, in the environment and as attributes.
OLDER = {"similarity_threshold": "SIMILARITY_MIN_SCORE", "similarity_top_k": "SIMILARITY_TOP_N", "similarity_overview_max_chars": "SIMILARITY_SUMMARY_MAX_CHARS", "api_key": "MOONSHOT_API_KEY"}
#: Least and greatest values, None where there is no such limit.
LIMITS = {"similarity_threshold": (0, 1), "similarity_top_k": (1, 50), "similarity_overview_max_chars": (200, 5000), "retrieval_overview_min_chars": (1, 5000), "retrieval_overview_max_chars": (100, 5000), "max_pdf_pages": (1, None), "max_pdf_bytes": (1, None), "max_request_bytes": (1 << 20, None), "max_structured_text_chars": (1000, None), "max_visual_regions": (1, None), "max_visual_total_bytes": (1024, None), "max_full_page_fallbacks": (0, None), "max_attempts": (1, 10), "schema_retry_attempts": (0, 3), "max_review_rounds": (1, None)}


@dataclass(frozen=True)
class Settings:
    api_key: str = field(default="", repr=False)
    reasoning_effort: str = "low"
    max_attempts: int = 3
    schema_retry_attempts: int = 1
    max_pdf_pages: int = 100
    max_pdf_bytes: int = 100 << 20
    max_request_bytes: int = 90 << 20
    max_structured_text_chars: int = 500_000
    max_visual_regions: int = 60
    max_visual_total_bytes: int = 15 << 20
    max_full_page_fallbacks: int = 4
    similarity_threshold: float = 0.35
    similarity_top_k: int = 5
    similarity_overview_max_chars: int = 1200
    retrieval_overview_min_chars: int = 100
    retrieval_overview_max_chars: int = 1500
    max_review_rounds: int = 3
    enable_admin_notify: bool = True

    def __post_init__(self) -> None:
        object.__setattr__(self, "reasoning_effort", self.reasoning_effort.strip().lower())
        if self.reasoning_effort not in ("low", "high", "max"):
            raise ValueError("reasoning_effort must be low, high or max")
        for name, (low, high) in LIMITS.items():
            value = getattr(self, name)
            if value < low or high is not None and value > high:
                raise ValueError(f"{name} is out of its limits")
        if self.retrieval_overview_min_chars > self.retrieval_overview_max_chars:
            raise ValueError("retrieval_overview_min_chars must not exceed retrieval_overview_max_chars")

    similarity_min_score = property(lambda self: self.similarity_threshold)
    similarity_top_n = property(lambda self: self.similarity_top_k)
    similarity_summary_max_chars = property(lambda self: self.similarity_overview_max_chars)

    def redacted(self) -> dict[str, object]:
        """All settings but secrets, of which only their presence is told."""
        out = asdict(self)
        return out | {"api_key_present": bool(out.pop("api_key"))}


def typed(value: object, default: object) -> object:
    if isinstance(default, bool):
        return value if isinstance(value, bool) else str(value).strip().lower() in TRUE
    return type(default)(value)


def load(path: str | Path | None = None, environ: dict[str, str] | None = None) -> Settings:
    """Settings by name in upper case from the environment, else its older name, else the file's, else the default."""
    env = os.environ if environ is None else environ
    given = json.loads(Path(path).read_text(encoding="utf-8-sig")) if path else {}
    if unknown := set(given) - {f.name for f in fields(Settings)}:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    out = Settings()
    values = {f.name: env.get(f.name.upper(), env.get(OLDER.get(f.name, ""), given.get(f.name))) for f in fields(Settings)}
    return replace(out, **{k: typed(v, getattr(out, k)) for k, v in values.items() if v is not None})
