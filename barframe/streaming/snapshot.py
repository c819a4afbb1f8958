"""State of steps as text: typed, versioned, and read without running anything that it names.

Only classes of the registry are made again, and only by setting their attributes; a
snapshot of another version, of an unknown class or beyond the size limit is refused.
"""

from __future__ import annotations

import json
import math
from collections import deque

from ..operators import recursive, steps, strategy
from . import outputs

#: To be raised when a step's attributes change their meaning.
VERSION = 1
MAX_BYTES = 8 << 20
CLASSES = {c.__name__: c for m in (recursive, steps, strategy, outputs) for c in vars(m).values() if isinstance(c, type) and c.__module__ == m.__name__}


def _plain(x):
    if x is None or isinstance(x, bool | int | str):
        return x
    if isinstance(x, float):
        return x if math.isfinite(x) else {"f": str(x)}
    if isinstance(x, list):
        return [_plain(v) for v in x]
    if isinstance(x, tuple):
        return {"t": [_plain(v) for v in x]}
    if isinstance(x, deque):
        return {"q": [_plain(v) for v in x], "max": x.maxlen}
    if isinstance(x, dict):
        return {"d": [[_plain(k), _plain(v)] for k, v in x.items()]}
    if CLASSES.get(type(x).__name__) is type(x):
        return {"o": type(x).__name__, "a": {k: _plain(v) for k, v in vars(x).items()}}
    raise TypeError(f"{type(x).__name__} has no place in a snapshot")


def _made(x):
    if isinstance(x, list):
        return [_made(v) for v in x]
    if not isinstance(x, dict):
        return x
    if "f" in x:
        return float(x["f"])
    if "t" in x:
        return tuple(_made(v) for v in x["t"])
    if "q" in x:
        return deque((_made(v) for v in x["q"]), x["max"])
    if "d" in x:
        return {_made(k): _made(v) for k, v in x["d"]}
    if x.get("o") not in CLASSES:
        raise ValueError(f"a snapshot names an unknown class: {x.get('o')}")
    out = object.__new__(CLASSES[x["o"]])
    for k, v in x["a"].items():
        object.__setattr__(out, k, _made(v))
    return out


def encode(state: object, max_bytes: int = MAX_BYTES) -> str:
    text = json.dumps({"version": VERSION, "state": _plain(state)}, separators=(",", ":"), allow_nan=False)
    if len(text) > max_bytes:
        raise ValueError(f"a snapshot of {len(text)} bytes is over the limit of {max_bytes}")
    return text


def decode(text: str, max_bytes: int = MAX_BYTES) -> object:
    if len(text) > max_bytes:
        raise ValueError(f"a snapshot of {len(text)} bytes is over the limit of {max_bytes}")
    data = json.loads(text)
    if not isinstance(data, dict) or data.get("version") != VERSION:
        raise ValueError("a snapshot of another version")
    return _made(data["state"])
