"""The best few of very many scores, kept while they come by."""

from __future__ import annotations

import numpy as np

#: Scores held in one matrix at a time.
CELLS = 1 << 20


def slice_rows(groups: int) -> int:
    """How many candidates go into a matrix of scores beside so many groups."""
    return max(16, CELLS // max(groups, 1))


class Best:
    """The ``k`` highest scores of each of ``n`` groups; of equal ones the smallest places (of one kind that sorts)."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.group, self.score, self.place = np.zeros(0, np.int64), np.zeros(0), None
        self._least, self._last, self._full = np.full(n, -np.inf), None, np.zeros(n, bool)

    def _wins(self, group: np.ndarray, score: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Which candidates could be among the best as they stand; all arguments broadcast."""
        out = score > self._least[group]
        if self._last is not None:
            out |= (score == self._least[group]) & (place < self._last[group])
        return out | ~self._full[group]

    def offer_all(self, scores: np.ndarray, places: np.ndarray) -> None:
        """A score of each group (rows) for each place (columns)."""
        # places are compared only where scores do not settle it
        group, at = np.nonzero(scores >= np.where(self._full, self._least, -np.inf)[:, None])
        self.offer(group, scores[group, at], places[at])

    def offer(self, group: np.ndarray, score: np.ndarray, place: np.ndarray) -> None:
        wins = self._wins(group, score, place)
        self._keep(group[wins], score[wins], place[wins])

    def _keep(self, group: np.ndarray, score: np.ndarray, place: np.ndarray) -> None:
        if not len(group):
            return
        if self.place is not None:
            group, score, place = np.concatenate([self.group, group]), np.concatenate([self.score, score]), np.concatenate([self.place, place])
        order = np.lexsort((place, -score, group))
        group = group[order]
        nth = np.arange(len(group)) - np.searchsorted(group, group)
        order, group = order[nth < self.k], group[nth < self.k]
        self.group, self.score, self.place = group, score[order], place[order]
        ends = np.nonzero(nth[nth < self.k] == self.k - 1)[0]
        full = group[ends]
        self._last = np.zeros(self.n, self.place.dtype) if self._last is None else self._last.astype(self.place.dtype)
        self._full[full], self._least[full], self._last[full] = True, self.score[ends], self.place[ends]
