"""Look-ups in the nested spans of a file, each in logarithmic time."""

from __future__ import annotations

from bisect import bisect_left, bisect_right


class Nesting:
    """The innermost span at a place: of spans (first, end, ...) that are nested or apart."""

    def __init__(self, spans, strict: bool = False):
        """strict leaves the first place of a span outside it."""
        self.at: list[int] = []
        self.top: list[tuple | None] = []
        stack: list[tuple] = []

        def close(until: int) -> None:
            while stack and stack[-1][1] <= until:
                end = stack.pop()[1]
                self._mark(end, stack[-1] if stack else None)

        for s in sorted(spans, key=lambda s: (s[0], -s[1])):
            close(s[0] + strict)
            stack.append(s)
            self._mark(s[0] + strict, s)
        close(1 << 62)

    def _mark(self, at: int, top: tuple | None) -> None:
        if self.at and self.at[-1] == at:
            self.top[-1] = top
        else:
            self.at.append(at)
            self.top.append(top)

    def __call__(self, place: int) -> tuple | None:
        i = bisect_right(self.at, place) - 1
        return self.top[i] if i >= 0 else None


def between(spans: list[tuple], first: int, end: int) -> list[tuple]:
    """The spans that begin at first or later and before end; spans are sorted."""
    return spans[bisect_left(spans, (first,)) : bisect_left(spans, (end,))]
