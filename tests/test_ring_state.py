"""A ring's state keeps no event that the next watermark passes, and no more Python objects at once than EVENTS_AT_ONCE."""

from types import SimpleNamespace

import numpy as np
import pandas as pd

from lodestrand.operators.feedback import fold
from lodestrand.streaming import jobs


class Held:
    def __init__(self):
        self.rows, self.most = [], 0

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows = list(rows)

    def appendList(self, rows):
        self.rows += rows
        self.most = max(self.most, len(rows))

    def clear(self):
        self.rows = []


def test_only_events_within_the_delay_are_kept():
    ring, states = jobs.Ring(10, 60_000), {}
    ring.init(SimpleNamespace(getListState=lambda name, _: states.setdefault(name, Held())))
    r, n, all_events, reached = np.random.default_rng(5), 30_000, [], 0
    for k in range(3):
        ms = 1_700_000_000_000 + k * 3_000_000 + r.integers(0, 3_000_000, n)
        frame = pd.DataFrame({"owner": "o", "key": [f"k{x}" for x in r.integers(0, 40, n)], "id": [f"{k}-{i:06}" for i in range(n)], "ts": pd.to_datetime(ms, unit="ms"), "op": r.choice(["add", "delete", "toggle"], n)})
        all_events += [e for e in zip((ms * 1000).tolist(), frame["id"], frame["op"], frame["key"], strict=True) if e[0] > reached * 1000]
        frames = (frame.iloc[i : i + 4_000] for i in range(0, n, 4_000))
        out = next(ring.handleInputRows(("o",), frames, SimpleNamespace(getCurrentWatermarkInMs=lambda w=reached: w)))
        reached = int(ms.max()) - 60_000
        wanted = fold([(e[2], e[3], e[1]) for e in sorted(all_events)], [], 10)
        assert list(zip(out["key"], out["id"], strict=True)) == list(reversed(wanted))
        assert 0 < len(states["pending"].rows) < n // 10 and min(e[0] for e in states["pending"].rows) > reached * 1000
    assert states["pending"].most <= jobs.EVENTS_AT_ONCE
