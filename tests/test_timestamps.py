import datetime as dt
import itertools

import numpy as np
import pytest

from corpuscle.operators import timestamps as T


def norm(value, zone=None):
    c = T.interpretations(value, zone)
    return T.render(c[0][1], min(c, key=lambda x: x[3])[2]) if c else None


@pytest.mark.parametrize(
    "value,zone,want",
    [
        ("06/01/2022", "America/New_York", "2022-06-01"),
        ("06/01/2022", "Europe/London", "2022-01-06"),
        ("2022/06/01", "America/New_York", "2022-06-01"),
        ("22.10.21", "America/New_York", "2021-10-22"),
        ("4. September 2022", "Europe/Berlin", "2022-09-04"),
        ("11 de agosto de 2023", None, "2023-08-11"),
        ("2021年10月9日", "Asia/Tokyo", "2021-10-09"),
        ("January 13th, 2019", None, "2019-01-13"),
        ("25-Sep-2025", None, "2025-09-25"),
        ("  2025-09-03 ", None, "2025-09-03"),
        ("1767827105", "Asia/Tokyo", "2026-01-07T23:05:05Z"),
        ("1731552159935", None, "2024-11-14T02:42:39Z"),
        ("20220203054628", "Asia/Tokyo", "2022-02-03T05:46:28Z"),
        ("20210816", "Asia/Tokyo", "2021-08-16"),
        ("2025-06-12T05:46:20+05:30", None, "2025-06-12T00:16:20Z"),
        ("2019-04-12 06:44:07+00", None, "2019-04-12T06:44:07Z"),
        ("2024-03-10 02:30:00", "America/New_York", "2024-03-10T07:30:00Z"),  # skipped: moves forward by the gap
        ("2024-11-03 01:30:00", "America/New_York", "2024-11-03T05:30:00Z"),  # twice: the earlier
        ("Nov 3, 2024, 1:30 am ET", None, "2024-11-03T05:30:00Z"),
        ("October 29, 2025 1:01 AM JST", None, "2025-10-28T16:01:00Z"),
        ("28 mars 2021 à 0h43", "Europe/Paris", "2021-03-27T23:43:00Z"),
        ("12.11.2020 03:24 Uhr", "Europe/Berlin", "2020-11-12T02:24:00Z"),
        ("2024-09-05T14:28:43[America/Los_Angeles]", None, "2024-09-05T21:28:43Z"),
        ("2025-09-19T03:08:22.592243475Z", None, "2025-09-19T03:08:22Z"),
        ("Sat, 02 Nov 2019 15:17:00 -0400", None, "2019-11-02T19:17:00Z"),
    ],
)
def test_readings(value, zone, want):
    assert norm(value, zone) == want


@pytest.mark.parametrize("value", [None, "", "   ", "unknown", "n/a", "Spring 2024", "2023-05", "30 February 2022", "forthcoming", "99/99/2020"])
def test_no_reading(value):
    assert T.interpretations(value, "Europe/London") == []


def brute(states):
    best = None
    for path in itertools.product(*[range(len(s)) for s in states]):
        cost = states[0][path[0]][3] + sum(T._step([a[i]], [b[j]])[0, 0] for a, b, i, j in zip(states, states[1:], path, path[1:]))
        if best is None or cost < best[0] - 1e-9:
            best = (cost, path)
    return best


def path_cost(states, path):
    return states[0][path[0]][3] + sum(T._step([a[i]], [b[j]])[0, 0] for a, b, i, j in zip(states, states[1:], path, path[1:]))


def test_viterbi_is_optimal():
    rng = np.random.default_rng(3)
    for _ in range(60):
        states = [[(str(rng.integers(3)), False, int(rng.integers(5)), float(rng.integers(2))) for _ in range(rng.integers(1, 4))] for _ in range(6)]
        assert path_cost(states, T.viterbi(states)) == pytest.approx(brute(states)[0])


def test_partitions_do_not_change_the_path(spark):
    # without a zone both readings of a slash date are open: neighbours decide, across partition borders too
    days = ["03/04/2020", "05/04/2020", "13/04/2020", "04/05/2020", None, "x", "06/05/2020", "07/05/2020", "30/05/2020"] * 7
    rows = [(f"d{i:03}", "s" if i % 9 else "t", d, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)) for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, "doc_id string, src string, date string, at timestamp").selectExpr("*", "cast(null as string) as zone", "1 as norm")
    got = {n: {tuple(r) for r in T.normalise(df, "src", ["at", "doc_id"], "date", "zone", ["doc_id"], n).collect()} for n in (1, 2, 5, 13)}
    cost = {}
    for n, out in got.items():
        fmt = {r[0]: r[2] for r in out}
        assert len(out) == len(rows)
        total = 0.0
        for s in ("s", "t"):
            chain = [(d, v) for d, src, v, _ in rows if src == s and T.interpretations(v, None)]
            states = [T.interpretations(v, None) for _, v in chain]
            path = [[c[0] for c in st].index(fmt[d]) for (d, _), st in zip(chain, states)]
            total += path_cost(states, path)
        cost[n] = total
    assert len(set(cost.values())) == 1


def test_streamed_path_is_the_whole_path(monkeypatch):
    monkeypatch.setattr(T, "OPEN", 5)
    rng = np.random.default_rng(5)
    for _ in range(60):
        chain = []
        for src in ("a", "b", "c"):
            for _ in range(rng.integers(1, 60)):
                chain.append((src, [(str(rng.integers(3)), False, int(rng.integers(9)), float(rng.integers(2))) for _ in range(rng.integers(1, 4) if rng.random() < 0.1 else rng.integers(2, 4))]))
        leave = rng.random(len(chain[-1][1]))
        c = T._Chooser(None, leave)
        for i, (src, states) in enumerate(chain):
            c.add(0, i, src, states)
        assert len(c.open) < len(chain)
        c.end()
        got = {row: (fmt, norm) for row, fmt, norm in c.done[0]}
        for src in ("a", "b", "c"):
            idx = [i for i, (x, _) in enumerate(chain) if x == src]
            states = [chain[i][1] for i in idx]
            path = T.viterbi(states, None, leave if src == "c" else None)
            assert [got[i] for i in idx] == [(s[k][0], T.render(s[k][1], s[k][2])) for s, k in zip(states, path)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id string, src string, date string, at timestamp, zone string")
    assert T.normalise(df, "src", ["at"], "date", "zone", ["doc_id"]).count() == 0
