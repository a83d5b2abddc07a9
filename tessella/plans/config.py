"""Nested settings as an object: attributes for keys, with joins and updates."""

from __future__ import annotations

from typing import Any


class Settings(dict):
    """A dict whose keys are attributes too; nested dicts become Settings. An unknown name is an AttributeError."""

    def __init__(self, values: dict[str, Any] | None = None, **more: Any):
        super().__init__()
        for k, v in {**(values or {}), **more}.items():
            self[k] = Settings(v) if isinstance(v, dict) else v

    def __getattr__(self, name: str) -> Any:
        try:
            return self[name]
        except KeyError:
            raise AttributeError(name) from None

    def __setattr__(self, name: str, value: Any) -> None:
        self[name] = value

    def joined(self, other: dict[str, Any]) -> Settings:
        """A copy with the other's values over its own, level by level."""
        out = Settings(self)
        for k, v in other.items():
            out[k] = out[k].joined(v) if isinstance(v, dict) and isinstance(out.get(k), Settings) else Settings(v) if isinstance(v, dict) else v
        return out
