"""What a Python worker keeps between tasks: built models and a bounded table of answers."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

#: Entries of one table; a full table is emptied and filled anew (answers stay the same).
MOST = 500_000

_kept: dict[Any, Any] = {}


def kept(key: Any, build: Callable[[], Any]) -> Any:
    """One object for each key in this worker.  A worker holds a few: the last eight."""
    if key not in _kept:
        while len(_kept) >= 8:
            _kept.pop(next(iter(_kept)))
        _kept[key] = build()
    return _kept[key]


class Memo(dict):
    """Answers by chunk of text.  ``answer`` takes the list of chunks that are new."""

    def __init__(self, answer: Callable[[list[bytes]], Iterable[Any]], most: int = MOST):
        super().__init__()
        self.answer, self.most = answer, most

    def learn(self, texts: Iterable[list[bytes]]) -> None:
        """Make sure that every chunk of ``texts`` has its answer."""
        new = set().union(*texts).difference(self)
        if len(self) + len(new) > self.most:
            self.clear()
            new = set().union(*texts)
        if new:
            new = list(new)
            self.update(zip(new, self.answer(new)))
