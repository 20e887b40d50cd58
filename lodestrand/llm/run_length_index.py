"""A run-compressed Burrows-Wheeler index of short texts, and matching statistics of other texts streamed through it."""

from __future__ import annotations

import numpy as np

#: Arrays up to 2**PLACES long are sorted as (key, place) packed in one number, which is much faster than sorting places by key.
PLACES = 21
#: Symbols that are compared at a time.
CHUNK = 16


def _order(keys: np.ndarray, limit: int) -> np.ndarray:
    """The stable order of ``keys``, which are below ``limit``."""
    if len(keys) < 1 << PLACES and limit < 1 << (63 - PLACES):
        return np.sort((keys << PLACES) | np.arange(len(keys))) & ((1 << PLACES) - 1)
    return np.argsort(keys, kind="stable")


def _ranks(keys: np.ndarray, limit: int) -> np.ndarray:
    """Dense ranks of ``keys``, which are below ``limit``."""
    order = _order(keys, limit)
    new = np.empty(len(keys), np.int64)
    ordered = keys[order]
    new[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
    return new


def laid_out(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Texts end to end, each followed by an end mark (-1): text k, symbols[ends[k]:ends[k + 1]], begins at ends[k] + k."""
    out = np.full(len(symbols) + len(ends) - 1, -1, symbols.dtype)
    out[np.arange(len(symbols)) + np.repeat(np.arange(len(ends) - 1), np.diff(ends))] = symbols
    return out


class RunLengthIndex:
    """The runs of the transform of some texts, each run with the text places of its first and last row. Nothing else is kept: no text, no suffix array.

    End marks differ, in the order of the texts, so all suffixes do; they are sorted once, by doubling, and forgotten."""

    def __init__(self, text: np.ndarray):
        """``text``: what ``laid_out`` gives, of at least one text."""
        n = self.n = len(text)
        text = text.astype(np.int64)
        marks = text < 0
        rank = _ranks(np.where(marks, np.cumsum(marks), text + marks.sum() + 1), int(text.max(initial=0) + marks.sum()) + 2)
        depth = 1
        while rank.max() + 1 < n:
            shifted = np.zeros(n, np.int64)
            shifted[: n - depth] = rank[depth:] + 1
            rank, depth = _ranks(rank * (n + 2) + shifted, (n + 2) ** 2), 2 * depth
        order = np.empty(n, np.int64)
        order[rank] = np.arange(n)
        last = text[order - 1]  # before the first symbol stands the last end mark
        heads = np.flatnonzero(np.concatenate(([True], last[1:] != last[:-1])))
        ends = np.append(heads[1:], n) - 1
        #: Runs by symbol and row; the sum of lengths before a run is where its first row leads.
        by = np.lexsort((heads, last[heads]))
        self.symbol, self.head, self.end = last[heads[by]], heads[by], ends[by]
        self.keys = (self.symbol + 1) * n + self.head
        long = self.end - self.head + 1
        self.leads = np.cumsum(long) - long
        self.head_place, self.end_place = order[self.head], order[self.end]

    @property
    def runs(self) -> int:
        return len(self.head)

    @property
    def bytes(self) -> int:
        return sum(x.nbytes for x in (self.symbol, self.head, self.end, self.keys, self.leads, self.head_place, self.end_place))

    def statistics(self, symbols: np.ndarray, ends: np.ndarray, text: np.ndarray, least: int = 0, pivots: np.ndarray | None = None) -> np.ndarray:
        """For each place of the texts in ``symbols`` how long the longest match is that begins there and stands in an indexed text.

        With ``pivots``, a place in each text, only matches of ``least`` symbols or more that begin at or before it and hold it are asked for; other places
        may get 0. A text is done once its match ends too far left for that: matches that begin further left end no further right.

        The texts run backwards, side by side. Each holds a row whose suffix matches as far as any does, and that suffix's place. If the row's run has the
        next symbol, the row is mapped and the match grows by one. If not, the nearest rows that have it, the end of a run above and the head of one
        below, are the only ones that can match longest; their places are sampled, and how far either matches is read off ``text`` (``laid_out``), the
        one use that is made of it."""
        out = np.zeros(len(symbols), np.int64)
        who = np.flatnonzero(np.diff(ends) > 0)
        at = ends[who + 1] - 1
        row = np.full(len(who), self.n - 1)
        place, length = np.full(len(who), self.end_place[np.argmax(self.end)]), np.zeros(len(who), np.int64)
        while len(who):
            c = symbols[at].astype(np.int64)
            run = np.searchsorted(self.keys, (c + 1) * self.n + row, "right") - 1  # the run of the symbol that holds the row or is the last one above it
            above = (run >= 0) & (self.symbol[np.maximum(run, 0)] == c)
            same = above & (self.end[np.maximum(run, 0)] >= row)
            other = np.flatnonzero(~same)
            if len(other):
                up, down = run[other], np.minimum(run[other] + 1, self.runs - 1)
                has_up, has_down = above[other], (run[other] + 1 < self.runs) & (self.symbol[down] == c[other])
                up = np.maximum(up, 0)
                both = np.concatenate((self.end_place[up], self.head_place[down]))
                most = np.concatenate((np.where(has_up, length[other], 0), np.where(has_down, length[other], 0)))
                matched = self._matched(symbols, np.tile(at[other] + 1, 2), text, both, most).reshape(2, -1)
                lower = has_down & (~has_up | (matched[1] > matched[0]))
                none = ~has_up & ~has_down
                run[other] = np.where(lower, down, up)
                row[other] = np.where(none, row[other], np.where(lower, self.head[down], self.end[up]))
                place[other] = np.where(none, place[other], np.where(lower, self.head_place[down], self.end_place[up]))
                length[other] = np.where(none, -1, np.where(lower, matched[1], matched[0]))
                same[other] = ~none
            row = np.where(same, self.leads[np.maximum(run, 0)] + row - self.head[np.maximum(run, 0)], row)
            place = np.where(same, place - 1, place)
            length += 1
            out[at] = length
            more = at > ends[who]
            if pivots is not None:
                more &= (at > pivots[who]) | (at + length - ends[who] >= least)
            who, at, row, place, length = who[more], at[more] - 1, row[more], place[more], length[more]
        return out

    @staticmethod
    def _matched(symbols: np.ndarray, at: np.ndarray, text: np.ndarray, place: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many symbols from ``at`` on equal the text's from ``place`` on, up to ``most``."""
        done = np.zeros(len(at), np.int64)
        left = np.flatnonzero(most > 0)
        steps = np.arange(CHUNK)
        while len(left):
            a, b = at[left] + done[left], place[left] + done[left]
            equal = symbols[np.minimum(a[:, None] + steps, len(symbols) - 1)] == text[np.minimum(b[:, None] + steps, len(text) - 1)]
            equal &= done[left][:, None] + steps < most[left][:, None]
            n = np.where(equal.all(axis=1), CHUNK, np.argmin(equal, axis=1))
            done[left] += n
            left = left[n == CHUNK]
        return done
