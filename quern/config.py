"""Settings of a pipeline run."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class PipelineConfig:
    out: str
    target_chars: int = 1000
    overlap: int = 150
    embed: bool = True
    full_text: bool = True
    rebuild: bool = False
    site_slug: str | None = None
    embed_batch: int = 64
    embed_pause: float = 0.0


@dataclass(frozen=True)
class RetrievalConfig:
    vector_pool: int = 50
    text_pool: int = 50
    top_k: int = 5
    use_text: bool = False
    recent_days: int | None = None
    least_score: float = 0.2
    metric: str = "cosine"


def project_root(start: str | Path, marks: tuple[str, ...] = ("config.yaml", "pyproject.toml", ".git")) -> Path:
    """The nearest folder above ``start`` that holds one of ``marks``, or ``start`` itself."""
    here = Path(start).resolve()
    return next((p for p in (here, *here.parents) if any((p / m).exists() for m in marks)), here)


def ensure_folder(path: str | Path) -> Path:
    Path(path).mkdir(parents=True, exist_ok=True)
    return Path(path)
