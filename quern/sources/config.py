"""Settings from YAML with ``${NAME}`` and ``${NAME:-default}``, a ``.env`` file, defaults and validation."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping, MutableMapping
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any

from ..operators.answers import NO_CONTEXT

_VARIABLE = re.compile(r"\$\{([A-Za-z_]\w*)(?::-([^}]*))?\}", re.A)


class InvalidConfig(ValueError):
    pass


@dataclass
class Retrieval:
    chunk_size: int = 800
    chunk_overlap: int = 0
    top_k: int = 5
    similarity_threshold: float = 0.0
    ingest_workers: int = 2
    no_context_reply: str = NO_CONTEXT
    fusion: str = "nested"
    coarse_limit: int | None = None


@dataclass
class Rerank:
    enabled: bool = False
    model: str = ""
    candidate_pool: int = 30
    top_n: int = 0
    timeout_sec: int = 15


@dataclass
class Embedding:
    model: str = "hashing"
    dimension: int = 256
    batch_size: int = 16


@dataclass
class Models:
    embedding: Embedding = field(default_factory=Embedding)
    rerank: Rerank = field(default_factory=Rerank)
    timeout_sec: int = 120


@dataclass
class Server:
    max_upload_size_mb: int = 20
    admin_users: list[str] = field(default_factory=list)


@dataclass
class Config:
    server: Server = field(default_factory=Server)
    ai: Models = field(default_factory=Models)
    rag: Retrieval = field(default_factory=Retrieval)

    def validate(self) -> Config:
        if not self.ai.embedding.model:
            raise InvalidConfig("ai.embedding.model is empty")
        if self.ai.rerank.enabled and not self.ai.rerank.model:
            raise InvalidConfig("ai.rerank.enabled needs ai.rerank.model")
        if not 0 <= self.rag.chunk_overlap < self.rag.chunk_size:
            raise InvalidConfig(f"rag.chunk_overlap {self.rag.chunk_overlap} must be below rag.chunk_size {self.rag.chunk_size}")
        return self


def expand(text: str, env: Mapping[str, str] | None = None) -> str:
    """Variables replaced; an unset one without a default stays as it is."""
    env = os.environ if env is None else env
    return _VARIABLE.sub(lambda m: env.get(m[1], m[2] or m[0]), text)


def load_dotenv(text: str, env: MutableMapping[str, str] | None = None) -> None:
    """Set what ``text`` (lines NAME=value) names and the environment doesn't have yet."""
    env = os.environ if env is None else env
    for line in text.splitlines():
        name, equals, value = line.strip().removeprefix("export ").partition("=")
        name, value = name.strip(), value.strip()
        if not equals or not name or name.startswith("#"):
            continue
        quoted = re.match(r"""(["'])(.*?)\1""", value)
        env.setdefault(name, quoted[2] if quoted else value.split(" #")[0].strip())


def _fill(kind: type, values: Mapping[str, Any] | None) -> Any:
    """``kind`` from what is known of ``values``; zero and empty values leave the default, unknown names are ignored."""
    found = {}
    for f in fields(kind):
        value = (values or {}).get(f.name)
        default = f.default_factory() if callable(f.default_factory) else f.default
        if is_dataclass(default):
            found[f.name] = _fill(type(default), value)
        elif value not in (None, 0, "", []):
            found[f.name] = value
    return kind(**found)


def load(text: str, env: Mapping[str, str] | None = None) -> Config:
    import yaml

    return _fill(Config, yaml.safe_load(expand(text, env)) or {}).validate()
