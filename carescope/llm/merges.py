"""How byte-pair merges build tokens, and which neighbours an encoding can have.

A merge system is a function ``rank(left, right)`` over symbols (``bytes`` or ``str``), None where
the pair has no merge; merging concatenates. Encoding takes the pair of least rank, the leftmost
of equals, until no pair has a merge.

Two facts make left-to-right work possible: the tokens of every prefix form an encoding, and a
token sequence is an encoding exactly when each pair of neighbours is. ``Merges.follows`` decides
the pair: it replays the merges inside both tokens side by side, in rank order, and looks for one
that would first cross the border.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

END = float("inf")


class Merges:
    """Replayed merge histories of tokens; histories and pair verdicts are kept, up to ``keep``."""

    def __init__(self, rank: Callable, base: Callable[[object], Sequence], keep: int = 1_000_000):
        self.rank, self.base, self.keep = rank, base, keep
        self._history: dict = {}
        self._pairs: dict = {}

    def encode(self, symbols: Sequence) -> tuple[list, list]:
        """The tokens of a symbol sequence, and the events (rank, leftmost, rightmost) on the way."""
        rank, parts = self.rank, list(symbols)
        events = [(-1, parts[0], parts[-1])] if parts else []
        ranks = [rank(a, b) for a, b in zip(parts, parts[1:])]
        while True:
            known = [r for r in ranks if r is not None]
            if not known:
                return parts, events
            best = min(known)
            i = ranks.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank(parts[i], parts[i + 1])
            if i:
                ranks[i - 1] = rank(parts[i - 1], parts[i])
            events.append((best, parts[0], parts[-1]))

    def history(self, token) -> list | None:
        """The events that build a token from its base symbols; None if no text yields the token."""
        if token not in self._history:
            parts, events = self.encode(self.base(token))
            self._history[token] = events if len(parts) == 1 else None
        return self._history[token]

    def follows(self, left, right) -> bool:
        """Whether ``right`` directly after ``left`` stays as these two tokens."""
        key = (left, right)
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= self.keep:
                self._pairs.clear()
            known = self._pairs[key] = self._replay(self.history(left), self.history(right))
        return known

    def _replay(self, a: list, b: list) -> bool:
        rank, i, j = self.rank, 0, 0
        while True:
            cross = rank(a[i][2], b[j][1])
            next_a = a[i + 1][0] if i + 1 < len(a) else END
            next_b = b[j + 1][0] if j + 1 < len(b) else END
            # of equal ranks the leftmost merge goes first: inside a, then across, then inside b
            if cross is not None and cross < next_a and cross <= next_b:
                return False
            if next_a is END and next_b is END:
                return True
            if next_a <= next_b:
                i += 1
            else:
                j += 1
