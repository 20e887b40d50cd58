"""Minimal acyclic transducers: kept terms of one two-byte prefix each, with the terms' places in lexicographic order as outputs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from .buffers import LOWER


def build(terms: Sequence[bytes]) -> dict[str, bytes]:
    """The transducer of sorted distinct terms that share their first two bytes (or are that one byte): walking the bytes from the third on, the
    outputs along the way add up to the term's place among ``terms``.

    Equal right languages share a state, so the machine is minimal. An output counts the terms that leave its state by smaller bytes or end there."""
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    known: dict[tuple, int] = {}

    def settle(node: list) -> int:
        right = (node[0], tuple(node[1]))
        if right not in known:
            known[right] = len(states)
            states.append(right)
        return known[right]

    path: list[list] = [[False, []]]  # nodes of the last term, each (final, [(byte, settled state)]); the last one's child is not settled yet
    last = b""
    for term in terms:
        rest = term[2:]
        common = next((k for k, (x, y) in enumerate(zip(last, rest)) if x != y), min(len(last), len(rest)))
        while len(path) > common + 1:
            done = path.pop()
            path[-1][1].append((last[len(path) - 1], settle(done)))
        path += [[False, []] for _ in range(len(rest) - common)]
        path[-1][0] = True
        last = rest
    while len(path) > 1:
        done = path.pop()
        path[-1][1].append((last[len(path) - 1], settle(done)))
    start = settle(path[0])
    size = [0] * len(states)
    for s, (final, moves) in enumerate(states):  # children are settled before their parents
        size[s] = final + sum(size[t] for _, t in moves)
    number = {start: 0} | {s: k for k, s in enumerate((s for s in range(len(states)) if s != start), 1)}
    keys, targets, outs, finals = [], [], [], bytearray(len(states))
    for s in sorted(number, key=number.get):
        final, moves = states[s]
        finals[number[s]] = final
        before = int(final)
        for byte, t in moves:
            keys.append(number[s] << 8 | byte)
            targets.append(number[t])
            outs.append(before)
            before += size[t]
    return {
        "keys": np.array(keys, np.int64).tobytes(),
        "targets": np.array(targets, np.int64).tobytes(),
        "outs": np.array(outs, np.int64).tobytes(),
        "finals": bytes(finals),
    }


def _slots(keys: np.ndarray, shift: int) -> np.ndarray:
    return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(shift)).astype(np.int64)


def _hash_table(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """(places of keys by slot, shift): open addressing, a quarter full at most. A key that finds its slot taken goes to the next one."""
    bits = max(4, int(4 * len(keys)).bit_length())
    table, shift = np.full(1 << bits, -1, np.int64), 64 - bits
    left, slot = np.arange(len(keys)), _slots(keys, shift)
    while len(left):
        free = table[slot[left]] < 0
        table[slot[left[free]]] = left[free]
        left = left[table[slot[left]] != left]
        slot[left] = (slot[left] + 1) & ((1 << bits) - 1)
    return table, shift


class Vocabulary:
    """Transducers of many prefixes and languages as one table of transitions, which whole arrays of words walk at once."""

    def __init__(self, machines: Sequence):
        """``machines``: rows of lang, prefix (the two bytes; a zero second byte for terms of one byte), first (ordinal of the first term), and build()'s columns."""
        self.langs = {lang: k for k, lang in enumerate(dict.fromkeys(m["lang"] for m in machines))}
        self.starts = np.full((max(len(self.langs), 1), 65536), -1, np.int64)
        self.firsts = np.zeros_like(self.starts)
        keys, targets, outs, finals, states = [], [], [], [], 0
        for m in machines:
            at = (self.langs[m["lang"]], m["prefix"][0] << 8 | (m["prefix"] + b"\0")[1])
            self.starts[at], self.firsts[at] = states, m["first"]
            keys.append(np.frombuffer(m["keys"], np.int64) + (states << 8))
            targets.append(np.frombuffer(m["targets"], np.int64) + states)
            outs.append(np.frombuffer(m["outs"], np.int64))
            finals.append(np.frombuffer(m["finals"], np.uint8))
            states += len(m["finals"])
        joined = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
        self.keys, self.targets, self.outs = joined(keys, np.int64), joined(targets, np.int64), joined(outs, np.int64)
        self.finals = joined(finals, np.uint8).astype(bool)
        self.table, self.shift = _hash_table(self.keys)

    def _transitions(self, key: np.ndarray) -> np.ndarray:
        """The place of each key among the transitions, -1 for those that aren't there."""
        slot = _slots(key, self.shift)
        found = self.table[slot]
        other = np.flatnonzero((found >= 0) & (self.keys[found] != key)) if len(self.keys) else np.empty(0, np.int64)
        while len(other):
            slot[other] = (slot[other] + 1) & (len(self.table) - 1)
            found[other] = self.table[slot[other]]
            other = other[(found[other] >= 0) & (self.keys[found[other]] != key[other])]
        return found

    def ordinals(self, lang: np.ndarray, flat: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The ordinal of each word flat[first:end], A-Z lower-cased, in its language (a number of ``langs``, -1 for others), or -1 for words that aren't kept."""
        if not len(first) or not len(self.finals):
            return np.full(len(first), -1, np.int64)
        size = end - first
        lead = LOWER[flat[first]].astype(np.int64) << 8
        second = np.minimum(first + 1, len(flat) - 1)
        lead |= np.where(size > 1, LOWER[flat[second]], 0)
        state = np.where(lang >= 0, self.starts[lang, lead], -1)
        place = self.firsts[lang, lead]
        walking = np.flatnonzero((state >= 0) & (size > 2))
        at = 2
        while len(walking):
            found = self._transitions(state[walking] << 8 | LOWER[flat[first[walking] + at]])
            hit = found >= 0
            state[walking[~hit]] = -1
            walking, found = walking[hit], found[hit]
            state[walking] = self.targets[found]
            place[walking] += self.outs[found]
            at += 1
            walking = walking[size[walking] > at]
        return np.where((state >= 0) & self.finals[state], place, -1)
