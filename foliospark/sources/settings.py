"""Engine options."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class TranslatorOptions:
    chunk_size: int = 500
    verify: bool = True
    verify_strategy: str = "adaptive"
    verify_audit_rate: float = 0.10
    temperature: float = 0.3
    retry_temperature: float = 0.05
    top_p: float = 0.6
    top_k: int = 20
    #: Most tokens of an answer: of a short text, of any other, of a back-translation, of the field.
    short_tokens: int = 128
    normal_tokens: int = 512
    back_tokens: int = 256
    field_tokens: int = 64
    #: What a provider begins its random numbers with; none leaves that to it.
    seed: int | None = None
    #: Whether prompts have the block before, which asks for a document's blocks one after another.
    context: bool = True

    def __post_init__(self) -> None:
        if self.verify_strategy not in ("full", "adaptive"):
            raise ValueError(f"verify_strategy is full or adaptive, not {self.verify_strategy}")


def lookup(values: dict[str, Any], *keys: str, default: Any = None) -> Any:
    """The value under nested keys; the default where a key is missing, a level is no dictionary, or the value is None."""
    for key in keys:
        values = values.get(key) if isinstance(values, dict) else None
    return default if values is None else values
