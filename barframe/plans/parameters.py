"""Typed parameters of a study: declared with defaults and bounds, checked when values come in."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field
from typing import Any

from ..functions.times import Timeframe

KINDS = ("int", "float", "bool", "string", "enum", "color", "source", "timeframe", "symbol", "session", "time", "text", "price")
WORDS = {"true": True, "1": True, "yes": True, "false": False, "0": False, "no": False}
SOURCES = ("open", "high", "low", "close", "volume", "hl2", "hlc3", "ohlc4", "hlcc4")


@dataclass(frozen=True)
class Parameter:
    name: str
    kind: str
    default: Any
    minimum: float | None = None
    maximum: float | None = None
    options: tuple | None = None
    title: str = ""

    def check(self, value: Any) -> Any:
        """The value in the parameter's type, or ValueError."""
        try:
            value = self._typed(value)
        except (TypeError, ValueError) as e:
            raise ValueError(f"{self.name}: {value!r} is no {self.kind}") from e
        if self.options is not None and value not in self.options:
            raise ValueError(f"{self.name}: {value!r} is not one of {list(self.options)}")
        if self.minimum is not None and value < self.minimum or self.maximum is not None and value > self.maximum:
            raise ValueError(f"{self.name}: {value!r} is out of bounds")
        return value

    def _typed(self, value: Any) -> Any:
        if self.kind in ("int", "time"):
            if isinstance(value, bool) or float(value) != int(float(value)):
                raise ValueError
            return int(float(value))
        if self.kind in ("float", "price"):
            number = float(value)
            if isinstance(value, bool) or number != number or number in (float("inf"), float("-inf")):
                raise ValueError
            return number
        if self.kind == "bool":
            if isinstance(value, str):
                if value.strip().lower() not in WORDS:
                    raise ValueError
                return WORDS[value.strip().lower()]
            return bool(value)
        if self.kind == "source" and value not in SOURCES:
            raise ValueError
        if self.kind == "timeframe" and value:
            Timeframe.parse(str(value))
        return str(value) if self.kind != "enum" else value


@dataclass
class Parameters:
    """Declares parameters as a study asks for them, so the schema is known after one dry call."""

    given: Mapping[str, Any] = field(default_factory=dict)
    declared: dict[str, Parameter] = field(default_factory=dict)

    def get(self, name: str, kind: str, default: Any, minimum: float | None = None, maximum: float | None = None, options: Sequence | None = None, title: str = "") -> Any:
        if kind not in KINDS:
            raise ValueError(f"no kind of parameter: {kind}")
        p = Parameter(name, kind, default, minimum, maximum, tuple(options) if options is not None else None, title)
        if self.declared.setdefault(name, p) != p:
            raise ValueError(f"{name} is declared twice, differently")
        return p.check(self.given.get(name, default))

    def schema(self) -> list[dict]:
        return [asdict(p) for p in self.declared.values()]

    def unused(self) -> set[str]:
        return set(self.given) - set(self.declared)
