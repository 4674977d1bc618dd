"""Settings from environment variables."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

#: What counts as yes and as no.
YES, NO = {"1", "true", "yes", "on"}, {"0", "false", "no", "off"}


def text(name: str, default: str, env: Mapping[str, str] = os.environ) -> str:
    """The trimmed value; the default for a missing or blank one."""
    return env.get(name, "").strip() or default


def flag(name: str, default: bool, env: Mapping[str, str] = os.environ) -> bool:
    value = env.get(name, "").strip().lower()
    return True if value in YES else False if value in NO else default


def positive(name: str, default: int, env: Mapping[str, str] = os.environ) -> int:
    """A whole number above 0; else the default."""
    try:
        return max(int(env.get(name, "")), 0) or default
    except ValueError:
        return default


@dataclass
class Generator:
    """How answers are generated: a command that reads a prompt and prints an answer."""

    model: str = "qwen3"
    command: str = "ollama"
    timeout: int = 120
    enabled: bool = True

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ) -> Generator:
        return cls(text("RAG_LLM_MODEL", cls.model, env), text("RAG_OLLAMA_CMD", cls.command, env), positive("RAG_LLM_TIMEOUT_SECONDS", cls.timeout, env), flag("RAG_LLM_ENABLED", cls.enabled, env))
