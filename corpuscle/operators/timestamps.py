"""Normalising mixed timestamp spellings and zones to one unambiguous form.

Every value gets the array of all its valid interpretations (format, day or UTC instant, prior cost); a
Viterbi search over each source's record order picks one, charging for a change of format and for a jump
back in time.  A prior cost of ``RULED_OUT`` marks readings that the project's rules exclude (the later of
two possible instants, month first outside America, ...): it exceeds any sum of two transition costs, so
sequence evidence decides only where the rules leave a choice.

Scale: sources may be arbitrarily hot.  Rows are range-partitioned by (source, order) into parts of ``PART_ROWS``,
never grouped by source, and only then parsed, once; each partition yields only the min-plus summary of its first and
last source segment, the driver chains those (two short rows per partition), and a second pass over the checkpointed
partitions streams the exact path: what all remaining paths agree on is written and forgotten, which a record with
one reading always brings about.

Defined results: null, blank, nonsense and partial dates (no day) have no interpretation and give null;
rows without an actor or with an unknown zone read zoneless times as UTC; repeated rows are kept.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, small, squash, table

SWITCH, BACKWARD, RULED_OUT = 1.0, 1.0, 100.0
#: Rows of a partition; undecided records after which the remaining paths are compared.
PART_ROWS, OPEN = 1_000_000, 1024

# Month names and zone abbreviations as people write them.
MONTHS = {}
for _names in (
    "january february march april may june july august september october november december",
    "jan feb mar apr may jun jul aug sep oct nov dec",
    "januar februar märz april mai juni juli august september oktober november dezember",
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro",
    "gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre",
):
    for _i, _n in enumerate(_names.split(), 1):
        MONTHS.setdefault(_n, _i)
MONTHS |= {"sept": 9, "jänner": 1, "setiembre": 9}
OFFSETS = {
    "z": 0, "utc": 0, "gmt": 0, "wet": 0, "bst": 60, "west": 60, "cet": 60, "cest": 120, "eet": 120, "eest": 180,
    "msk": 180, "ist": 330, "jst": 540, "kst": 540, "est": -300, "edt": -240, "cst": -360, "cdt": -300,
    "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
}
REGIONS = {"et": "America/New_York", "ct": "America/Chicago", "mt": "America/Denver", "pt": "America/Los_Angeles"}

_TIME = (
    r"(?:[T,\s]\s*(?:at\s+|à\s+|um\s+|a las\s+)?(?P<h>\d{1,2})[:h](?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,]\d+)?)?"
    r"(?:\s*(?P<ap>[ap]\.?m\.?))?(?:\s*Uhr)?"
    r"(?:\s*(?:\[(?P<tz>[A-Za-z]+(?:/[A-Za-z_+\-0-9]+)*)\]|(?P<off>[+-]\d{2}(?::?\d{2})?)|(?P<ab>[A-Za-z]{1,4})))?)?"
)
_WD = r"(?:[^\W\d_]{2,10}\.?,\s*)?"
PATTERNS = [
    (name, re.compile(rf"\s*{body}{_TIME}\s*", re.I))
    for name, body in (
        ("ymd-", r"(?P<y>\d{4})-(?P<m>\d{1,2})-(?P<d>\d{1,2})"),
        ("ymd/", r"(?P<y>\d{4})/(?P<m>\d{1,2})/(?P<d>\d{1,2})"),
        ("ymd.", r"(?P<y>\d{4})\.(?P<m>\d{1,2})\.(?P<d>\d{1,2})\.?"),
        ("slash", r"(?P<a>\d{1,2})/(?P<b>\d{1,2})/(?P<y>\d{4}|\d{2})"),
        ("dmy.", r"(?P<d>\d{1,2})\.\s?(?P<m>\d{1,2})\.\s?(?P<y>\d{4}|\d{2})"),
        ("cjk", r"(?P<y>\d{4})\s*年\s*(?P<m>\d{1,2})\s*月\s*(?P<d>\d{1,2})\s*日"),
        ("d mon y", _WD + r"(?P<d>\d{1,2})(?:\.|st|nd|rd|th|er|º)?[\s-](?:de\s+)?(?P<mon>[^\W\d_]{3,12})\.?,?[\s-](?:de\s+)?(?P<y>\d{4})"),
        ("mon d y", _WD + r"(?P<mon>[^\W\d_]{3,12})\.?\s(?P<d>\d{1,2})(?:st|nd|rd|th)?,?\s(?P<y>\d{4})"),
    )
]
_DIGITS = re.compile(r"\s*([+-]?\d+)\s*")
_ZONES: dict[str, ZoneInfo | None] = {}
EPOCH = datetime(1970, 1, 1)


def _zone(name: str | None) -> ZoneInfo | None:
    if not name:
        return None
    if name not in _ZONES:
        try:
            _ZONES[name] = ZoneInfo(name)
        except Exception:
            _ZONES[name] = None
    return _ZONES[name]


def _seconds(local: datetime) -> int:
    return (local - EPOCH) // timedelta(seconds=1)


def _instants(local: datetime, zone: ZoneInfo | None) -> list[tuple[int, float]]:
    """UTC seconds of a wall-clock time: both readings of a repeated hour, the later one ruled out; a skipped
    time keeps the offset before the gap, which moves it forward by the gap."""
    if zone is None:
        return [(_seconds(local), 0.0)]
    a = _seconds(local) - int(local.replace(tzinfo=zone, fold=0).utcoffset().total_seconds())
    b = _seconds(local) - int(local.replace(tzinfo=zone, fold=1).utcoffset().total_seconds())
    return [(a, 0.0)] if b <= a else [(a, 0.0), (b, RULED_OUT)]


def interpretations(value: str | None, home_zone: str | None) -> list[tuple[str, bool, int, float]]:
    """All valid readings of ``value``: (format, tells only a day, UTC seconds, prior cost)."""
    if value is None or not value.strip():
        return []
    out: list[tuple[str, bool, int, float]] = []
    if m := _DIGITS.fullmatch(value):
        raw = m[1]
        n = len(raw)
        if raw.isdigit() and n in (8, 12, 14):
            try:
                t = datetime.strptime(raw, {8: "%Y%m%d", 12: "%Y%m%d%H%M", 14: "%Y%m%d%H%M%S"}[n])
                out.append((f"stamp{n}", n == 8, _seconds(t), 0.0))
            except ValueError:
                pass
        scale = {9: 1, 10: 1, 13: 10**3, 16: 10**6, 19: 10**9}.get(len(raw.lstrip("+-")))
        if scale:
            out.append((f"unix{n}", False, int(raw) // scale, 0.0))
        return out
    for name, pattern in PATTERNS:
        m = pattern.fullmatch(value)
        if not m:
            continue
        g = m.groupdict()
        y = int(g["y"])
        if len(g["y"]) == 2:
            y += 2000 if y < 70 else 1900
        if name == "slash":
            american = bool(home_zone) and home_zone.startswith("America/")
            a, b = int(g["a"]), int(g["b"])
            known = home_zone is not None
            days = [("mdy/", a, b, RULED_OUT if known and not american else 0.0), ("dmy/", b, a, RULED_OUT if american else 0.0)]
            if a == b:
                days = days[:1] if american else days[1:]
        else:
            mon = MONTHS.get(g["mon"].lower().rstrip(".")) if g.get("mon") else int(g["m"])
            if mon is None:
                continue
            days = [(name, mon, int(g["d"]), 0.0)]
        for fmt, mon, day, prior in days:
            try:
                t = datetime(y, mon, day)
                if g["h"] is None:
                    out.append((fmt, True, _seconds(t), prior))
                    continue
                h = int(g["h"])
                if g["ap"]:
                    if not 1 <= h <= 12:
                        continue
                    h = h % 12 + (12 if g["ap"][0] in "pP" else 0)
                t = t.replace(hour=h, minute=int(g["mi"]), second=int(g["s"] or 0))
            except ValueError:
                continue
            fmt += " hms" if g["s"] else " hm"
            ab = (g["ab"] or "").lower()
            if g["off"]:
                o = g["off"].replace(":", "")
                shift = (int(o[1:3]) * 60 + int(o[3:5] or 0)) * (-1 if o[0] == "-" else 1)
                out.append((fmt + " off", False, _seconds(t) - shift * 60, prior))
            elif ab in OFFSETS:
                out.append((fmt + " abbr", False, _seconds(t) - OFFSETS[ab] * 60, prior))
            elif g["tz"] or ab in REGIONS:
                zone = _zone(g["tz"] or REGIONS[ab])
                if zone is not None:
                    out += [(fmt + " zone", False, s, prior + p) for s, p in _instants(t, zone)]
            elif not ab:
                out += [(fmt + " local", False, s, prior + p) for s, p in _instants(t, _zone(home_zone))]
    return out


def render(day_only: bool, seconds: int) -> str:
    t = EPOCH + timedelta(seconds=int(seconds))
    return t.strftime("%Y-%m-%d" if day_only else "%Y-%m-%dT%H:%M:%SZ") if t.year >= 1000 else t.isoformat()


def _step(prev, cur) -> np.ndarray:
    """Transition costs between the readings of two records, prev x cur, with cur's priors."""
    return np.array([[(SWITCH if p[0] != c[0] else 0.0) + (BACKWARD if c[2] < p[2] else 0.0) + c[3] for c in cur] for p in prev])


def viterbi(states: list[list[tuple]], entry: np.ndarray | None = None, leave: np.ndarray | None = None) -> list[int]:
    """The cheapest path; ``entry``: cost of starting in each reading of the first record (priors included),
    ``leave``: what follows after each reading of the last one.  Ties go to the earlier reading."""
    cost = np.array([s[3] for s in states[0]]) if entry is None else entry
    back = []
    for prev, cur in zip(states, states[1:]):
        total = cost[:, None] + _step(prev, cur)
        back.append(total.argmin(axis=0))
        cost = total.min(axis=0)
    if leave is not None:
        cost = cost + leave
    path = [int(cost.argmin())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def _unpack(row) -> list[tuple]:
    return [(r["fmt"], r["day"], r["sec"], r["prior"]) for r in row]


_CAND = "array<struct<fmt:string,day:boolean,sec:bigint,prior:double>>"


def with_interpretations(df: DataFrame, value: str, zone: str, keep: list[str]) -> DataFrame:
    """``keep`` columns plus ``cand``, the array of readings of each row."""

    @F.pandas_udf(_CAND)
    def readings(v: pd.Series, z: pd.Series) -> pd.Series:
        memo: dict = {}
        out = []
        for pair in zip(v, z):
            if pair not in memo:
                memo[pair] = [{"fmt": f, "day": d, "sec": s, "prior": p} for f, d, s, p in interpretations(*pair)]
            out.append(memo[pair])
        return pd.Series(out)

    return df.select(*keep, value, readings(F.col(value), F.col(zone)).alias("cand"))


class _Chooser:
    """Viterbi over a stream of records: decided ones are handed out in ``done`` as {frame: [(row, format, norm)]}."""

    def __init__(self, entry: np.ndarray | None, leave: np.ndarray | None):
        self.entry, self.leave = entry, leave
        self.source, self.open, self.limit, self.done = None, [], OPEN, {}

    def _settle(self, upto: int, at: int) -> None:
        for frame, row, states, back in reversed(self.open[:upto]):
            fmt, day, sec, _ = states[at]
            self.done.setdefault(frame, []).append((row, fmt, render(day, sec)))
            at = int(back[at]) if back is not None else at
        del self.open[:upto]

    def add(self, frame: int, row: int, source: str, states: list[tuple]) -> None:
        back = None
        if source != self.source:
            if self.open:
                self._settle(len(self.open), int(self.cost.argmin()))
            self.cost = np.array([s[3] for s in states]) if self.entry is None else self.entry
            self.source, self.entry, self.limit = source, None, OPEN
        else:
            total = self.cost[:, None] + _step(self.last, states)
            back, self.cost = total.argmin(axis=0), total.min(axis=0)
        self.last = states
        self.open.append((frame, row, states, back))
        if len(states) == 1:
            self._settle(len(self.open), 0)
        elif len(self.open) >= self.limit:
            alive = set(range(len(states)))
            for j in range(len(self.open) - 1, -1, -1):
                if len(alive) == 1:
                    self._settle(j + 1, alive.pop())
                    break
                back = self.open[j][3]
                if back is None:
                    break
                alive = {int(back[x]) for x in alive}
            self.limit = max(OPEN, 2 * len(self.open))

    def end(self) -> None:
        if self.open:
            self._settle(len(self.open), int((self.cost if self.leave is None else self.cost + self.leave).argmin()))


def normalise(df: DataFrame, source: str, order: list[str], value: str, zone: str, keep: list[str], partitions: int | None = None) -> DataFrame:
    """``keep`` plus ``norm`` (null where nothing is told) and ``fmt`` for each row of ``df``.

    ``source`` and ``order`` columns define the sequences; they need not be in ``keep``.
    """
    spark = df.sparkSession
    n = partitions or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // PART_ROWS))
    renamed = df.select(
        *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)],
        F.coalesce(F.col(source), F.lit("")).alias("_src"),
        *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)],
        F.col(value).alias("_val"),
        F.col(zone).alias("_zone"),
    )
    ks, os_ = [f"k{i}" for i in range(len(keep))], [f"o{i}" for i in range(len(order))]
    ranged = renamed.repartitionByRange(n, "_src", *os_).sortWithinPartitions("_src", *os_, *ks)
    ranged = with_interpretations(ranged.withColumn("_pid", F.spark_partition_id()), "_val", "_zone", ["_pid", *ks, "_src"])
    ranged = cut(ranged.select("_pid", *ks, "_src", "cand"))

    def summary(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of the first and the last source of the partition: the readings at both ends and the costs between."""
        pid, runs = None, []
        for pdf in pdfs:
            for p, src, c in zip(pdf["_pid"], pdf["_src"], pdf["cand"]):
                pid = p
                if not len(c):
                    continue
                st = _unpack(c)
                if runs and runs[-1]["src"] == src:
                    r = runs[-1]
                    step = _step(r["last"], st)
                    r["through"] = (r["through"][:, :, None] + step[None]).min(axis=1)
                    r["last"] = st
                else:
                    own = np.full((len(st), len(st)), np.inf)
                    np.fill_diagonal(own, 0.0)
                    runs.append({"src": src, "first": st, "last": st, "through": own})
                    if len(runs) > 2:
                        del runs[1:-1]
        if runs:
            import pickle

            yield pd.DataFrame({"pid": [int(pid)], "blob": [pickle.dumps(runs)]})

    rows = ranged.select("_pid", "_src", "cand").mapInPandas(summary, "pid int, blob binary").collect()
    import pickle

    parts = {r["pid"]: pickle.loads(bytes(r["blob"])) for r in rows}
    ids = sorted(parts)
    entry: dict[int, np.ndarray] = {}
    leave: dict[int, np.ndarray] = {}

    def after(run, cost):  # costs at the run's last record
        return (cost[:, None] + run["through"]).min(axis=0)

    prev = None
    for p in ids:  # forwards: what the part of a source before this partition costs
        runs = parts[p]
        first = np.array([s[3] for s in runs[0]["first"]])
        if prev and prev[0]["src"] == runs[0]["src"]:
            first = (prev[1][:, None] + _step(prev[0]["last"], runs[0]["first"])).min(axis=0)
            entry[p] = first
        cost = after(runs[0], first) if len(runs) == 1 else after(runs[-1], np.array([s[3] for s in runs[-1]["first"]]))
        prev = (runs[-1], cost)
    nxt = None
    for p in reversed(ids):  # backwards: what the part after it costs
        runs = parts[p]
        last = np.zeros(len(runs[-1]["last"]))
        if nxt and nxt[0]["src"] == runs[-1]["src"]:
            last = (_step(runs[-1]["last"], nxt[0]["first"]) + nxt[1][None]).min(axis=1)
            leave[p] = last
        at_first = (runs[0]["through"] + (last if len(runs) == 1 else np.zeros(len(runs[0]["last"])))[None]).min(axis=1)
        nxt = (runs[0], at_first)

    def choose(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, frames = None, {}

        def decided() -> Iterator[pd.DataFrame]:
            for no, rows in path.done.items():
                at, fmt, norm = zip(*rows)
                yield frames[no][0].iloc[list(at)].assign(norm=norm, fmt=fmt)
                frames[no][1] -= len(at)
                if not frames[no][1]:
                    del frames[no]
            path.done = {}

        for no, pdf in enumerate(pdfs):
            if not len(pdf):
                continue
            if path is None:
                pid = int(pdf["_pid"].iloc[0])
                path = _Chooser(entry.get(pid), leave.get(pid))
            told = [len(c) > 0 for c in pdf["cand"]]
            if not all(told):
                yield pdf.loc[[not x for x in told], ks].assign(norm=None, fmt=None)
            frames[no] = [pdf[ks], sum(told)]
            for i, (src, c) in enumerate(zip(pdf["_src"], pdf["cand"])):
                if told[i]:
                    path.add(no, i, src, _unpack(c))
            yield from decided()
        if path is not None:
            path.end()
            yield from decided()

    types = dict(ranged.dtypes)
    out = ranged.mapInPandas(choose, ", ".join(f"{k} {types[k]}" for k in ks) + ", norm string, fmt string")
    return out.select(*[F.col(k).alias(c) for k, c in zip(ks, keep)], "norm", "fmt")


def corpus_dates(spark: SparkSession, sf: str) -> DataFrame:
    """corpus with ``home_zone`` joined by the actor's squashed name."""
    dim = table(spark, sf, "dim_actor").select(squash(F.col("actor")).alias("_src"), "actor", "home_zone").groupBy("_src").agg(F.min_by("home_zone", F.struct("actor", "home_zone")).alias("home_zone"))
    docs = table(spark, sf, "corpus").select("doc_id", "date", "scraped_at", squash(F.col("actor")).alias("_src"))
    return docs.join(small(dim), "_src", "left")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Each row whose date is not exactly YYYY-MM-DD but tells a day or an instant, with its normal form."""
    out = normalise(corpus_dates(spark, sf), "_src", ["scraped_at", "doc_id"], "date", "home_zone", ["doc_id", "date"])
    plain = F.coalesce(F.col("date").rlike(r"\A\d{4}-\d{2}-\d{2}\z"), F.lit(False))
    return out.where(F.col("norm").isNotNull() & ~plain).select("doc_id", "norm").distinct()


QUERIES = {"p7_found": p7_found}
