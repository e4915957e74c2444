"""Settings with their defaults, overlaid by environment variables (and a .env file) named DOCENGINE_<FIELD>."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field, fields
from functools import lru_cache
from pathlib import Path

PREFIX = "DOCENGINE_"


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Settings:
    llm_provider: str = "extractive"
    embedding_provider: str = "hashing"
    openai_base_url: str = "https://api.openai.com/v1"
    openai_api_key: str | None = None
    llm_model: str | None = None
    embedding_model: str | None = None
    azure_endpoint: str | None = None
    azure_api_key: str | None = None
    azure_api_version: str = "2024-06-01"
    llm_temperature: float = 0.0
    llm_max_tokens: int = 512
    request_timeout: float = 60.0
    embedding_batch_size: int = 64
    embedding_dim: int = 384
    store_path: str | None = None
    chunk_size: int = 800
    chunk_overlap: int = 120
    heading_aware: bool = True
    top_k: int = 5
    candidate_k: int = 20
    rrf_k: int = 60
    reranker: str = "none"
    api_keys: dict[str, list[str]] = field(default_factory=dict)
    max_upload_mb: int = 25
    cors_origins: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        for name, least, most in (("chunk_size", 50, None), ("chunk_overlap", 0, self.chunk_size - 1), ("top_k", 1, 50), ("candidate_k", 1, 200), ("rrf_k", 1, None), ("embedding_batch_size", 1, None), ("embedding_dim", 1, None)):
            value = getattr(self, name)
            if value < least or (most is not None and value > most):
                raise ConfigError(f"{name} must be from {least}" + (f" to {most}" if most is not None else " up"))
        for name, known in (("llm_provider", ("extractive", "openai", "azure")), ("embedding_provider", ("hashing", "openai", "azure")), ("reranker", ("none", "overlap"))):
            if getattr(self, name) not in known:
                raise ConfigError(f"{name} must be one of {', '.join(known)}")


def _parsed(kind: str, said: str):
    if kind.startswith("bool"):
        return said.strip().lower() in ("1", "true", "yes", "on")
    if kind.startswith("int"):
        return int(said)
    if kind.startswith("float"):
        return float(said)
    return json.loads(said) if kind.startswith(("dict", "list")) else said


def load(env: dict[str, str] | None = None, env_file: str | None = ".env", **own) -> Settings:
    """Defaults, then the file, then the environment, then ``own``; names that aren't settings are ignored."""
    said: dict[str, str] = {}
    if env_file and Path(env_file).is_file():
        for line in Path(env_file).read_text(encoding="utf-8").splitlines():
            if m := re.match(r"\s*(?:export\s+)?(\w+)\s*=\s*(.*?)\s*$", line):
                said[m[1].upper()] = m[2].strip("\"'")
    said |= {k.upper(): v for k, v in (os.environ if env is None else env).items()}
    values = {}
    for f in fields(Settings):
        if (key := PREFIX + f.name.upper()) in said:
            try:
                values[f.name] = _parsed(str(f.type), said[key])
            except ValueError as e:
                raise ConfigError(f"{key}: {e}") from e
    return Settings(**values | own)


@lru_cache
def get_settings() -> Settings:
    return load()
