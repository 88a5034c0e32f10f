"""The ratings stream holds a bounded number of buffered results, however many a watermark releases."""

import random
import tracemalloc

from terrace.streaming import ratings


class _Map:
    def __init__(self):
        self.held = {}

    containsKey = property(lambda self: self.held.__contains__)
    getValue = property(lambda self: self.held.__getitem__)

    def updateValue(self, key, value):
        self.held[key] = value


class _Buffer:
    """Results in no order, made as they are read."""

    def __init__(self, n):
        self.n, self.removed = n, 0

    def iterator(self):
        for i in range(self.n):
            k = i * 7919 % self.n
            yield (k // 40, k, k), ("PL", f"t{k % 20}", f"t{(k + 1 + k // 20 % 19) % 20}", k % 4, k % 3)

    def removeKey(self, key):
        self.removed += 1


def _processor(n):
    p = ratings.RatingsProcessor()
    p.teams, p.leagues, p.buffer = _Map(), _Map(), _Buffer(n)
    return p


def test_released_results_pass_in_order_and_in_bounded_memory():
    n = 120_000
    p = _processor(n)
    tracemalloc.start()
    seen = 0
    for frame in p._release(("c",), 10**15):
        assert frame.match_id.tolist() == list(range(seen, seen + len(frame)))
        seen += len(frame)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert seen == n == p.buffer.removed and p.leagues.held[("PL",)][0] == n
    print("peak MB", peak / 1e6)
    assert peak < 60e6


def test_sorted_runs_are_merged():
    rng = random.Random(4)
    items = [((rng.randrange(50), rng.randrange(50), i), ("x", None)) for i in range(2000)]
    for run_rows in (3000, 2000, 450, 7):
        assert list(ratings.in_order(iter(items), run_rows)) == sorted(items)
    assert list(ratings.in_order(iter([]), 5)) == []


def test_late_results_come_out_in_frames(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(ratings, "FRAME_ROWS", 10)
    p = _processor(0)

    class Timer:
        def getCurrentWatermarkInMs(self):
            return 10**15

    frames = [pd.DataFrame({"result_day": [1] * 15, "match_seq": range(15), "match_id": range(i, i + 15), "competition": "PL", "home_team": "a", "away_team": "b", "home_score": 1, "away_score": 0}) for i in (0, 15, 30)]
    out = list(p.handleInputRows(("c",), iter(frames), Timer()))
    assert [len(f) for f in out] == [15, 15, 15] and [m for f in out for m in f.match_id] == list(range(45))
    assert all(f.late.all() for f in out)
