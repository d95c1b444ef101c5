"""Stateful sessions of calls: micro-batches, restarts and ends against the batch answer."""

import datetime
import glob
import random
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from codeloom.streaming import sessions

GAP = 60_000


def calls_of(spark, rows):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    return spark.createDataFrame([(c, i, n, a, at(s)) for c, i, n, a, s in rows], "session_id string, event_id long, naive_tokens long, actual_tokens long, ts timestamp_ntz")


def wanted(rows):
    """Rows of calls by brute force, and those of sessions' ends before the last call of all."""
    out, ends, state = [], [], {}
    for c, i, n, a, s in sorted(rows, key=lambda r: (r[4], r[1])):
        number, calls, total, last = state.get(c, (1, 0, 0, None))
        if last is not None and (s - last) * 1000 > GAP:
            ends.append((c, "end", number, None, calls, total, None))
            number, calls, total = number + 1, 0, 0
        saved = max(0, n - a)
        state[c] = number, calls + 1, total + saved, s
        out.append((c, "call", number, i, calls + 1, total + saved, saved))
    return out, ends, state


ROWS = [("u", 1, 10, 4, 0), ("v", 2, 5, 9, 5), ("u", 3, 7, 7, 20), ("u", 4, 9, 1, 81), ("v", 5, 8, 2, 90), ("u", 6, 3, 1, 100), ("w", 7, 100, 1, 130), ("v", 8, 6, 5, 400), ("u", 9, 2, 1, 401), ("u", 10, 2, 1, 401), ("x", 11, 1, 0, 900)]


@pytest.mark.parametrize("batches", [1, 4])
def test_stream_equals_batch(spark, tmp_path, batches):
    found = sessions.replayed(calls_of(spark, ROWS), str(tmp_path), batches, GAP)
    rows = sorted(map(tuple, found.collect()), key=repr)
    out, ends, state = wanted(ROWS)
    calls = [r for r in rows if r[1] == "call"]
    assert calls == sorted(out, key=repr)
    late = [(c, "end", n, None, k, total, None) for c, (n, k, total, last) in state.items() if last < 800]  # by a timer, if the watermark came so far
    ended = [r for r in rows if r[1] == "end"]
    assert len(set(ended)) == len(ended) and set(ends) <= set(ended) <= set(ends + late)
    if batches > 1:
        assert spark.read.schema(sessions.OUTPUT).parquet(f"{tmp_path}/out").groupBy("kind").agg(F.count("*")).count() == 2


def test_timers_end_sessions(spark, tmp_path):
    place = str(tmp_path)
    sessions.replayed(calls_of(spark, [("u", 1, 10, 4, 0), ("u", 2, 10, 5, 10), ("z", 3, 1, 0, 500)]), place, 1, GAP)
    found = sessions.replayed(calls_of(spark, [("z", 4, 1, 0, 900)]), place, 1, GAP)
    assert ("u", "end", 1, None, 2, 11, None) in set(map(tuple, found.collect()))


class Handle:
    """State and timers of one group, and how many messages they took."""

    def __init__(self):
        self.value, self.timers, self.messages = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value, self.messages = value, self.messages + 1

    def registerTimer(self, at):
        self.timers.add(at)
        self.messages += 1

    def deleteTimer(self, at):
        self.timers.remove(at)
        self.messages += 1


def test_a_group_of_clients_is_one_call():
    r = random.Random(5)
    rows = sorted([(f"c{r.randrange(300)}" if r.random() < 0.99 else None, i, r.randrange(9), r.randrange(9), r.randrange(2000)) for i in range(3000)], key=lambda x: x[4])
    handle, found = Handle(), []
    group = sessions.Sessions(GAP)
    group.init(handle)
    for k in range(0, 3000, 750):
        part = rows[k : k + 750]
        r.shuffle(part)
        frame = pd.DataFrame([(c, i, max(0, n - a), s * 1000) for c, i, n, a, s in part], columns=["session_id", "event_id", "saved", "ms"])
        found += list(group.handleInputRows((0,), iter([frame[:300], frame[300:]]), None))
        if k == 1500:  # the watermark passes the ends of some sessions
            now = int(frame.ms.max())
            for at in sorted(t for t in handle.timers if t <= now):
                handle.timers.remove(at)
                found += list(group.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda: now), SimpleNamespace(getExpiryTimeInMs=lambda: at)))
    made = [tuple(None if pd.isna(x) else x for x in row) for f in found for row in f.itertuples(index=False)]
    out, ends, state = wanted(rows)
    assert sorted((x for x in made if x[1] == "call"), key=repr) == sorted(out, key=repr)
    ended = [x for x in made if x[1] == "end"]
    assert len(set(ended)) == len(ended) and set(ends) <= set(ended) <= set(ends) | {(c, "end", n, None, k, t, None) for c, (n, k, t, _) in state.items()}
    assert handle.messages <= 15 and len(handle.timers) == 1


def test_parts_are_written_by_many_tasks_and_read_at_once(spark, tmp_path):
    rows = [(f"u{i % 7}", i, i % 5, 1, 10 * i) for i in range(80)]
    found = sessions.replayed(calls_of(spark, rows).repartition(4, "event_id"), str(tmp_path), 2, GAP)
    assert sorted(map(tuple, found.where("kind = 'call'").collect()), key=repr) == sorted(wanted(rows)[0], key=repr)
    assert len(glob.glob(f"{tmp_path}/calls/*.parquet")) > 2
