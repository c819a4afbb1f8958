"""Steps over rows that aren't bars: living drawings, and requested timeframes on a chart."""

from __future__ import annotations

from collections import deque


class Drawings:
    """Living objects from the log of ``output.object_events``: made, changed and deleted; at most ``keep_last`` of a kind."""

    def __init__(self, keep_last: int | None = None):
        self.keep_last, self.objects = keep_last, {}

    def push(self, time: int, id: str, op: str, kind: str | None, props: dict | None) -> list[dict]:
        """The objects that this event touched, each as it is now."""
        props = dict(props or {})
        if op == "new":
            self.objects.pop(id, None)
            self.objects[id] = {"kind": kind, "time": time, "props": props}
            return [self._row(id), *self._forget(kind)]
        if id not in self.objects:
            return []
        if op == "delete":
            return [self._gone(id)]
        self.objects[id]["props"] |= props
        return [self._row(id)]

    def living(self, kind: str | None = None) -> list[str]:
        return [i for i, o in self.objects.items() if kind is None or o["kind"] == kind]

    def _row(self, id: str) -> dict:
        return {"id": id, "alive": True} | self.objects[id]

    def _gone(self, id: str) -> dict:
        return {"id": id, "alive": False} | self.objects.pop(id)

    def _forget(self, kind: str | None) -> list[dict]:
        own = self.living(kind)
        return [self._gone(i) for i in own[: max(len(own) - self.keep_last, 0)]] if self.keep_last is not None else []


class LastClosed:
    """A higher timeframe on a chart: the values of the last requested bar that has closed; with ``gaps`` on the bar of its close alone."""

    def __init__(self, gaps: bool = False):
        self.gaps, self.shown, self.seen = gaps, None, None

    def request(self, time: int, values: tuple) -> None:
        self.shown, self.seen = values, time

    def chart(self, time: int) -> tuple | None:
        return self.shown if not self.gaps or self.seen == time else None


class Inside:
    """Lower bars of the chart bar that is under way, told when the next one begins."""

    def __init__(self, max_size: int | None = None):
        self.max_size, self.bar, self.rows = max_size, None, deque()

    def lower(self, values: tuple) -> None:
        if self.bar is not None:
            if self.max_size is not None and len(self.rows) >= self.max_size:
                raise ValueError("a lower timeframe group is too large")
            self.rows.append(values)

    def chart(self, time: int) -> tuple[int, list[tuple]] | None:
        done = None if self.bar is None else (self.bar, list(self.rows))
        self.bar, self.rows = time, deque()
        return done
