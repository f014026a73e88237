"""Which embedding model, language model and vector store are asked for, checked before anything is built."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

EMBEDDERS, MODELS, STORES = ("local", "openai"), ("local", "openai", "anthropic"), ("parquet", "memory")
#: Providers that ask for a key, by the setting that holds it.
KEYS = {"openai": "OPENAI_API_KEY", "anthropic": "ANTHROPIC_API_KEY"}


class NotConfigured(ValueError):
    code = "NOT_CONFIGURED"


@dataclass(frozen=True)
class Providers:
    embedder: str = "local"
    model: str = "local"
    store: str = "memory"
    enabled: bool = True


def check(settings: Mapping[str, str]) -> list[str]:
    """All that is wrong with some settings, in words; an empty list if nothing is."""
    wrong = []
    if settings.get("ENABLE_RAG", "true").lower() != "true":
        return wrong
    for setting, allowed in (("EMBEDDING_PROVIDER", EMBEDDERS), ("LLM_PROVIDER", MODELS), ("VECTOR_STORE", STORES)):
        value = settings.get(setting)
        if value is not None and value not in allowed:
            wrong.append(f"{setting} is {value}, not one of {', '.join(allowed)}")
        elif value in KEYS and not settings.get(KEYS[value]):
            wrong.append(f"{setting} is {value}, and {KEYS[value]} is missing")
    return wrong


def providers(settings: Mapping[str, str]) -> Providers:
    """The providers that settings name, defaults where they name none; wrong settings are refused."""
    wrong = check(settings)
    if wrong:
        raise NotConfigured("; ".join(wrong))
    return Providers(
        settings.get("EMBEDDING_PROVIDER", "local"), settings.get("LLM_PROVIDER", "local"), settings.get("VECTOR_STORE", "memory"),
        settings.get("ENABLE_RAG", "true").lower() == "true",
    )
