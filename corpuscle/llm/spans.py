"""Long spans that occur verbatim in more than one record.

Method: a count-min prefilter.  Each text is reduced to anchors, the k-grams that are the least hash of some
``w`` consecutive ones, with k + w - 1 = ``length``: two copies of a span of ``length`` characters always share an
anchor.  Every task counts its anchors in a sparse sketch whose number of cells grows with the anchors; the sketches
are cut by ranges of cells and each range is merged by a task of its own, so no sketch ever fills up or has to fit
one machine.  The merged sketch never underestimates: an anchor in a cell counted once is certainly unique.  The
second pass keeps the anchors in cells counted more often, and only windows of full length whose least k-gram is
such an anchor are hashed, at all their positions, and grouped exactly (two independent 64-bit hashes) by the documents they
occur in; no shared window is lost.  Windows with the same least k-gram go through the grouping together, and are
taken apart only at the ends of copies.

Scale: both passes are maps over the scan.  The first sends some 3 bytes an anchor (3 % of the characters), sorted and
packed.  The repeated cells, folded to at most ``2**MAX_BITS`` bits (16 MB), are broadcast to spare the second
pass what is surely unique; where so many cells are repeated that the folded bits say little, the packed anchors
(some 13 bytes each) meet the exact cells of their range in a join instead, which costs less than reading the texts.
Texts move only where a document holds a repeated anchor.  Grouping keeps the least and greatest doc_id of a window, which
combines map-side: a passage held by a third of all documents stays one row per task, and no pairs arise.
Spans are put together per document with a running window over its own positions.

Defined results: lengths and offsets are code points of the stored text; null and short texts share nothing;
the same passage twice in one document is not shared; whole copies are; rows repeating a doc_id count as one
document, rows without one as none; very long texts are hashed in overlapping chunks.
"""
from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import cut, spread, table

LENGTH = 200
WINNOW = 65
#: Cells of the sketch per anchor, bits of the folded sketch that is broadcast at most.
CELLS, MAX_BITS = 256, 27
#: Anchors of a range of cells, ranges at most (a task's sketch has a row in each), anchors a task holds at once.
RANGE, MAX_RANGE_BITS, HELD = 1 << 18, 17, 1 << 20
#: Positions that are broadcast at most; runs with the same least k-gram that one task compares.
BROADCAST, LOCAL = 500_000, 2048
CHUNK = 1 << 19
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFE)
_SALT = np.uint64(0xA0761D6478BD642F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        up = np.full(size, np.uint64(base))
        down = np.full(size, np.uint64(pow(base, -1, 1 << 64)))
        up[0] = down[0] = 1
        have = _POWERS[base] = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return have


_BMP: dict[int, np.ndarray] = {}


def _letters(codes: np.ndarray, which: int) -> np.ndarray:
    """A random 64-bit number for each code point."""
    seed = np.uint64(0x9E3779B97F4A7C15 + which)
    if which not in _BMP:
        _BMP[which] = _mix(np.arange(1 << 16, dtype=np.uint64) + seed)
    if len(codes) and int(codes.max()) >= 1 << 16:
        return _mix(codes.astype(np.uint64) + seed)
    return _BMP[which][codes]


def prefixes(codes: np.ndarray, which: int) -> np.ndarray:
    """Polynomial prefix sums modulo 2**64."""
    up, _ = _powers(_BASES[which], len(codes) + 1)
    h = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(_letters(codes, which) * up[: len(codes)], dtype=np.uint64, out=h[1:])
    return h


def window_hashes(h: np.ndarray, width: int | np.ndarray, which: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hash of every window of ``width`` code points, or of those that start ``at``, from prefix sums."""
    _, down = _powers(_BASES[which], len(h))
    if at is None:
        if len(h) <= width:
            return np.zeros(0, dtype=np.uint64)
        return _mix((h[width:] - h[:-width]) * down[: len(h) - width])
    return _mix((h[at + width] - h[at]) * down[at])


def _slide(a: np.ndarray, w: int, f) -> np.ndarray:
    """f over every w consecutive entries, by doubling."""
    done, out = 1, a
    while done < w:
        step = min(done, w - done)
        out = f(out[:-step], out[step:])
        done += step
    return out


def anchors(h: np.ndarray, w: int) -> np.ndarray:
    """Which entries are the least of some ``w`` consecutive ones (all of them on ties)."""
    if len(h) < w:
        return np.zeros(len(h), dtype=bool)
    low = _slide(h, w, np.minimum)
    pad = np.zeros(w - 1, dtype=np.uint64)
    return _slide(np.concatenate([pad, low, pad]), w, np.maximum) == h


def _chunks(texts, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Concatenated pieces of texts: codes, and per piece its row, offset in the text and start in the codes."""
    codes, rows, offs, starts, size = [], [], [], [], 0
    for row, t in enumerate(texts):
        if t is None or len(t) < length:
            continue
        c = np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32)
        for at in range(0, max(1, len(c) - length + 1), CHUNK):
            piece = c[at : at + CHUNK + 2 * length]
            if len(piece) < length:
                continue
            codes.append(piece), rows.append(row), offs.append(at), starts.append(size)
            size += len(piece)
            if size >= CHUNK:
                yield np.concatenate(codes), np.array(rows), np.array(offs), np.array(starts)
                codes, rows, offs, starts, size = [], [], [], [], 0
    if codes:
        yield np.concatenate(codes), np.array(rows), np.array(offs), np.array(starts)


def _anchored(prefix: np.ndarray, starts: np.ndarray, length: int, w: int):
    """Hashes of all k-grams (the greatest number where one crosses two texts) and which are anchors."""
    k = length - w + 1
    h = window_hashes(prefix, k, 0) & ~np.uint64(1)  # the last bit is free for a mark
    for s in starts[1:].tolist():
        h[max(0, s - k + 1) : s] = _TOP
    return h, anchors(h, w) & (h != _TOP)


def _pack(a: np.ndarray, ordered: bool = True) -> bytes:
    """Numbers as packed bytes: differences where they are in order, equal places side by side."""
    d = np.diff(a, prepend=a.dtype.type(0)) if ordered else a
    return zlib.compress(d.view(np.uint8).reshape(-1, a.itemsize).T.tobytes(), 1)


def _unpack(b: bytes, kind=np.uint64, ordered: bool = True) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(b), dtype=np.uint8)
    a = raw.reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()
    return np.cumsum(a, dtype=kind) if ordered else a


class Sketch:
    """Sizes of a sketch of ``anchors``: 2**bits cells in 2**range_bits ranges, 2**fold bits for the tasks."""

    def __init__(self, anchors: int, max_bits: int | None = None):
        self.range_bits = min(MAX_RANGE_BITS, max(0, math.ceil(math.log2(anchors / RANGE)) if anchors > RANGE else 0))
        self.bits = min(60, max(self.range_bits + 8, math.ceil(math.log2(CELLS * (anchors + 1)))))
        self.fold = max(self.range_bits + 3, min(MAX_BITS if max_bits is None else max_bits, self.bits))

    def cells(self, h: np.ndarray) -> np.ndarray:
        return _mix(h ^ _SALT) >> np.uint64(64 - self.bits)

    def ranges(self, cells: np.ndarray) -> Iterator[tuple[int, slice]]:
        """The ranges of sorted cells and where they lie."""
        r = (cells >> np.uint64(self.bits - self.range_bits)).astype(np.int64)
        at = np.flatnonzero(np.append(True, r[1:] != r[:-1])) if len(r) else []
        for a, b in zip(at, [*at[1:], len(r)]):
            yield int(r[a]), slice(a, b)


def sketch(df: DataFrame, text: str, sk: Sketch, length: int = LENGTH, w: int = WINNOW) -> DataFrame:
    """(rng, more, bits): per range the packed cells with at least two documents, and the same folded to bits."""

    def emit(held: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        cells, n = np.unique(np.concatenate(held), return_counts=True)
        rows = [(r, _pack(cells[at][n[at] == 1]), _pack(cells[at][n[at] > 1])) for r, at in sk.ranges(cells)]
        if rows:
            yield pd.DataFrame(rows, columns=["rng", "ones", "more"])

    def count(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for pdf in pdfs:
            for codes, rows, _offs, starts in _chunks(pdf[text], length):
                h, sel = _anchored(prefixes(codes, 0), starts, length, w)
                at = np.flatnonzero(sel)
                doc, c = rows[np.searchsorted(starts, at, side="right") - 1], sk.cells(h[at])
                order = np.lexsort((c, doc))
                doc, c = doc[order], c[order]
                held.append(c[np.append(True, (c[1:] != c[:-1]) | (doc[1:] != doc[:-1]))] if len(c) else c)  # once per document
                size += len(held[-1])
                if size >= HELD:
                    yield from emit(held)
                    held, size = [], 0
        if held:
            yield from emit(held)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        more = [_unpack(x) for x in pdf["more"]]
        cells, n = np.unique(np.concatenate([*map(_unpack, pdf["ones"]), *more, *more]), return_counts=True)
        cells = cells[n > 1]
        bits = np.zeros(1 << (sk.fold - sk.range_bits), dtype=bool)
        bits[((cells >> np.uint64(sk.bits - sk.fold)) & np.uint64(len(bits) - 1)).astype(np.int64)] = True
        return pd.DataFrame({"rng": pdf["rng"].iloc[:1], "more": [_pack(cells)], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    parts = df.select(text).mapInPandas(count, "rng int, ones binary, more binary")
    return parts.groupBy("rng").applyInPandas(merge, "rng int, more binary, bits binary")


def _folded(merged: DataFrame, sk: Sketch) -> np.ndarray:
    """The folded sketch: 2**fold bits, at most 2**MAX_BITS / 8 bytes."""
    out = np.zeros((1 << sk.range_bits, 1 << (sk.fold - sk.range_bits - 3)), dtype=np.uint8)
    for r in merged.select("rng", "bits").collect():
        out[r["rng"]] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    return out.ravel()


def _repeated(df: DataFrame, key: str, text: str, merged: DataFrame, sk: Sketch, length: int, w: int) -> DataFrame:
    """(key, pos) of the anchors in cells counted more than once."""
    kind = dict(df.dtypes)[key]
    shared = df.sparkSession.sparkContext.broadcast(_folded(merged, sk))

    def emit(held: list[tuple]) -> Iterator[pd.DataFrame]:
        cells, ids, pos = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(cells, kind="stable")
        cells, ids, pos = cells[order], ids[order], pos[order]
        rows = [(r, _pack(cells[at]), ids[at].tolist(), _pack(pos[at], False)) for r, at in sk.ranges(cells)]
        if rows:
            yield pd.DataFrame(rows, columns=["rng", "cells", "ids", "at"])

    def find(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, held, size = shared.value, [], 0
        for pdf in pdfs:
            ids = pdf[key].to_numpy()
            for codes, rows, offs, starts in _chunks(pdf[text], length):
                h, sel = _anchored(prefixes(codes, 0), starts, length, w)
                at = np.flatnonzero(sel)
                c = sk.cells(h[at])
                f = (c >> np.uint64(sk.bits - sk.fold)).astype(np.int64)
                often = (bits[f >> 3] >> (f & 7).astype(np.uint8) & 1).astype(bool)
                at, c = at[often], c[often]
                piece = np.searchsorted(starts, at, side="right") - 1
                held.append((c, ids[rows[piece]], at - starts[piece] + offs[piece]))
                size += len(at)
                if size >= HELD:
                    yield from emit(held)
                    held, size = [], 0
        if size:
            yield from emit(held)

    def keep(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng, more = None, None
        for pdf in pdfs:
            for r, cells, ids, at, m in zip(pdf["rng"], pdf["cells"], pdf["ids"], pdf["at"], pdf["more"]):
                if r != rng:
                    rng, more = r, _unpack(m)
                if len(more):
                    cells = _unpack(cells)
                    hit = more[np.minimum(np.searchsorted(more, cells), len(more) - 1)] == cells
                    yield pd.DataFrame({key: np.asarray(ids)[hit], "pos": _unpack(at, np.int64, False)[hit]})

    found = df.mapInPandas(find, f"rng int, cells binary, ids array<{kind}>, at binary")
    return found.join(merged.select("rng", "more"), "rng").mapInPandas(keep, f"{key} {kind}, pos bigint")


def _maybe(rows: DataFrame, column, n: int):
    """A test (may pass others, misses none) for the 64-bit hashes ``column`` of the ``n`` ``rows``: a bit set of at
    most ``2**MAX_BITS`` bits, built in the JVM."""
    bits = min(MAX_BITS, max(16, math.ceil(math.log2(16 * (n + 1)))))
    cell = lambda c: F.shiftrightunsigned(c, 64 - bits)
    blocks = rows.select(cell(column).alias("c")).groupBy(F.shiftright("c", 15).alias("b")).agg(F.bitmap_construct_agg(F.col("c").bitwiseAND(F.lit(32767))).alias("bits"))
    seen = np.zeros((max(1, (1 << bits) >> 15), 4096), dtype=np.uint8)
    for r in blocks.collect():  # at most 2**MAX_BITS / 8 bytes
        seen[r["b"]] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(seen.ravel())

    @F.pandas_udf("boolean")
    def maybe(c: pd.Series) -> pd.Series:
        x = c.to_numpy().astype(np.int64)
        return pd.Series((shared.value[x >> 3] >> (x & 7).astype(np.uint8) & 1).astype(bool))

    return lambda c: maybe(cell(c))


def _holders(df: DataFrame, key: str, hits: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``hits``, with ``at``, its positions.  Up to ``BROADCAST`` positions go to the
    texts; more are joined with them, and a test of the keys keeps the other texts out of the shuffle."""
    n = hits.count()
    at = hits.groupBy(key).agg(F.collect_set("pos").alias("at"))
    if n <= BROADCAST:
        return df.join(F.broadcast(at), key)
    near = df.withColumn("_h", F.xxhash64(key))
    return near.where(_maybe(hits, F.xxhash64(key), n)(F.col("_h"))).drop("_h").join(at, key)


def _runs(df: DataFrame, key: str, text: str, length: int, w: int) -> DataFrame:
    """Stretches of windows whose least k-gram is estimated repeated (those ``at`` are): at most ``w`` consecutive
    windows with the same least k-gram make one row (its hash, two hashes of the text they cover, that text)."""
    kind = dict(df.dtypes)[key]

    def emit(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            ids, texts = pdf[key].to_numpy(), pdf[text].tolist()
            marks = [np.asarray(x, dtype=np.int64) for x in pdf["at"]]
            for codes, rows, offs, starts in _chunks(texts, length):
                first = prefixes(codes, 0)
                h, _ = _anchored(first, starts, length, w)
                if len(h) < w:
                    continue
                ends = np.append(starts[1:], len(codes))
                at = [x[(x >= 0) & (x < e - s)] + s for r, o, s, e in zip(rows, offs, starts, ends) if len(x := marks[r] - o)]
                at = np.concatenate(at) if at else np.zeros(0, dtype=np.int64)
                at = at[at < len(h)]
                # the least k-gram of a window is an anchor in every copy of it: its estimate decides for the window
                h[at] |= np.uint64(1)
                low = _slide(h, w, np.minimum)
                pos = np.flatnonzero(low & np.uint64(1))
                piece = np.searchsorted(starts, pos, side="right") - 1
                inside = pos + length <= ends[piece]
                pos, piece = pos[inside], piece[inside]
                if not len(pos):
                    continue
                least = low[pos]
                fresh = np.append(True, (pos[1:] != pos[:-1] + 1) | (least[1:] != least[:-1]) | (piece[1:] != piece[:-1]))
                begin = np.flatnonzero(fresh)
                since = np.arange(len(pos)) - np.repeat(begin, np.diff(np.append(begin, len(pos))))
                begin = np.flatnonzero(since % w == 0)
                m = np.diff(np.append(begin, len(pos)))
                pos, piece, least = pos[begin], piece[begin], least[begin]
                second = prefixes(codes, 1)
                size = m.astype(np.uint64)
                h1 = _mix(window_hashes(first, m + length - 1, 0, pos) + size)
                h2 = _mix(window_hashes(second, m + length - 1, 1, pos) + size)
                local, row = pos - starts[piece] + offs[piece], rows[piece]
                yield pd.DataFrame({
                    key: ids[row], "pos": local.astype(np.int64), "m": m.astype(np.int32), "least": least.view(np.int64), "h1": h1.view(np.int64), "h2": h2.view(np.int64),
                    "piece": [texts[r][o : o + k + length - 1] for r, o, k in zip(row.tolist(), local.tolist(), m.tolist())],
                })

    return df.select(key, text, "at").mapInPandas(emit, f"{key} {kind}, pos bigint, m int, least bigint, h1 bigint, h2 bigint, piece string")


def _windows_of(part: pd.DataFrame, length: int):
    """Row, offset and two hashes of every window of the pieces."""
    codes = np.frombuffer("".join(part["piece"]).encode("utf-32-le"), dtype=np.uint32)
    m = part["m"].to_numpy().astype(np.int64)
    begin = np.cumsum(m + length - 1) - (m + length - 1)
    off = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
    pos = np.repeat(begin, m) + off
    return np.repeat(np.arange(len(part)), m), off, window_hashes(prefixes(codes, 0), length, 0, pos), window_hashes(prefixes(codes, 1), length, 1, pos)


_PART = "h1 bigint, h2 bigint, off int, m int"


def _within(runs: DataFrame, length: int) -> DataFrame:
    """Stretches of windows (h1, h2, off, m) of the runs of one document that occur in another; the runs with the same
    least k-gram lie in the same bucket."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        row, off, w1, w2 = _windows_of(pdf, length)
        order = np.lexsort((w2, w1))
        same = np.append(False, (w1[order][1:] == w1[order][:-1]) & (w2[order][1:] == w2[order][:-1]))
        group = np.empty(len(order), dtype=np.int64)
        group[order] = np.cumsum(~same)
        codes, _ = pd.factorize(pd.concat([pdf["lo"], pdf["hi"]]))
        lo, hi = codes[: len(pdf)][row], codes[len(pdf) :][row]
        least, most = np.full(len(row) + 1, len(codes)), np.full(len(row) + 1, -1)
        np.minimum.at(least, group, np.minimum(lo, hi))
        np.maximum.at(most, group, np.maximum(lo, hi))
        at = np.flatnonzero((lo == hi) & (least[group] != most[group]))
        begin = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (row[at][1:] != row[at][:-1]))) if len(at) else at
        of = pdf.iloc[row[at[begin]]]
        return pd.DataFrame({"h1": of["h1"].to_numpy(), "h2": of["h2"].to_numpy(), "off": off[at[begin]].astype(np.int32), "m": np.diff(np.append(begin, len(at))).astype(np.int32)})

    return runs.groupBy("bucket").applyInPandas(compare, _PART)


def _across(runs: DataFrame, length: int) -> DataFrame:
    """The same for any number of runs with the same least k-gram: every window is a row."""
    kind = dict(runs.dtypes)["lo"]

    def each(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for at in range(0, len(pdf), 4000):
                part = pdf.iloc[at : at + 4000]
                row, off, w1, w2 = _windows_of(part, length)
                of = part.iloc[row]
                yield pd.DataFrame({**{c: of[c].to_numpy() for c in ("h1", "h2", "lo", "hi")}, "off": off.astype(np.int32), "w1": w1.view(np.int64), "w2": w2.view(np.int64)})

    windows = cut(runs.mapInPandas(each, f"h1 bigint, h2 bigint, lo {kind}, hi {kind}, off int, w1 bigint, w2 bigint"))
    twice = windows.groupBy("w1", "w2").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("w1", "w2")
    return windows.where("lo = hi").join(twice, ["w1", "w2"], "left_semi").select("h1", "h2", "off", F.lit(1).alias("m"))


def shared_runs(df: DataFrame, key: str, text: str, length: int = LENGTH, w: int = WINNOW, max_bits: int | None = None) -> DataFrame:
    """(key, pos, m): the windows of ``length`` that start at pos .. pos + m - 1 occur in another document too.

    Runs with the same text in two documents are shared whole.  What is left are the ends of copies, where a run has
    a text of its own: those runs, and one representative of each other run with the same least k-gram, are taken
    apart into windows, which are grouped exactly."""
    base = spread(df.select(F.col(key), F.col(text).alias("_text")).where(F.col(key).isNotNull() & (F.length(text) >= length)))
    chars = base.agg(F.coalesce(F.sum(F.length("_text").cast("bigint")), F.lit(0))).first()[0]
    sk = Sketch(2 * chars // (w + 1), max_bits)
    hits = cut(_repeated(base, key, "_text", cut(sketch(base, "_text", sk, length, w)), sk, length, w))
    runs = cut(_runs(_holders(base, key, hits), key, "_text", length, w))
    groups = cut(runs.groupBy("h1", "h2").agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.first("least").alias("least"), F.min(F.struct(key, "pos")).alias("first")))
    alone = F.col("lo") == F.col("hi")
    # least k-grams of several runs, not all of which are shared whole
    open_ = groups.groupBy("least").agg(F.count(F.lit(1)).alias("n"), F.count_if(alone).alias("own")).where("n > 1 and own > 0").select("least", "n")
    opened = cut(groups.join(open_, "least").select("h1", "h2", "least", "n", "lo", "hi", "first"))
    n = opened.count()
    whole = runs.select(key, "pos", "m", "h1", "h2").join(groups.where(~alone).select("h1", "h2"), ["h1", "h2"], "left_semi").select(key, "pos", "m")
    if not n:
        return whole
    # one representative of each with its text
    place = F.xxhash64(key, "pos")
    pieces = runs.select(key, "pos", "m", "piece", "h1", "h2").withColumn("_h", place).where(_maybe(opened.select("first.*"), place, n)(F.col("_h"))).drop("_h")
    pieces = pieces.dropDuplicates(["h1", "h2", key, "pos"]).withColumnsRenamed({key: "_k", "pos": "_p"})
    apart = pieces.join(opened, ["h1", "h2"]).where((F.col("_k") == F.col(f"first.{key}")) & (F.col("_p") == F.col("first.pos")))
    apart = cut(apart.select("h1", "h2", "n", "lo", "hi", "m", "piece", F.pmod(F.xxhash64("least"), F.lit(max(1, n // LOCAL))).alias("bucket")))
    part = _within(apart.where(F.col("n") <= LOCAL), length).unionByName(_across(apart.where(F.col("n") > LOCAL), length))
    ends = runs.select(key, "pos", "h1", "h2").join(part, ["h1", "h2"]).select(key, (F.col("pos") + F.col("off")).alias("pos"), "m")
    return whole.unionByName(ends)


def repeated_windows(df: DataFrame, key: str, text: str, length: int = LENGTH, w: int = WINNOW, max_bits: int | None = None) -> DataFrame:
    """(key, pos) of every window of ``length`` that occurs in another document too."""
    runs = shared_runs(df, key, text, length, w, max_bits)
    return runs.select(key, F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("m") - 1)).alias("pos")).distinct()


def spans(runs: DataFrame, key: str, length: int = LENGTH) -> DataFrame:
    """(key, start, n_chars): maximal stretches covered by shared windows."""
    w = W.partitionBy(key).orderBy("pos", "m")
    last = runs.select(key, "pos", "m", (F.col("pos") + F.col("m") - 1).alias("last"))
    reach = F.max("last").over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = last.withColumn("new", F.when(reach.isNull() | (F.col("pos") > reach + length), 1).otherwise(0))
    g = marked.withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0))).groupBy(key, "run").agg(F.min("pos").alias("start"), F.max("last").alias("last"))
    return g.select(key, "start", (F.col("last") + length - F.col("start")).alias("n_chars"))


def _windows(spark: SparkSession, sf: str) -> DataFrame:
    return shared_runs(table(spark, sf, "documents"), "doc_id", "text")


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a span of at least 200 characters that also occurs in another one."""
    return _windows(spark, sf).select("doc_id").distinct()


def p10_spans(spark: SparkSession, sf: str) -> DataFrame:
    return spans(_windows(spark, sf), "doc_id")


def p10_shared(spark: SparkSession, sf: str) -> DataFrame:
    """For each document, how much of it is shared elsewhere (0 for none; null and empty texts have 0 of 0)."""
    docs = table(spark, sf, "documents").groupBy("doc_id").agg(F.max(F.coalesce(F.length("text"), F.lit(0))).cast("bigint").alias("n_chars"))
    s = spans(_windows(spark, sf), "doc_id").groupBy("doc_id").agg(F.sum("n_chars").alias("shared_chars"), F.count(F.lit(1)).alias("n_spans"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return docs.join(s, "doc_id", "left").select("doc_id", "n_chars", z("shared_chars"), z("n_spans"), F.round(F.coalesce(F.try_divide("shared_chars", "n_chars"), F.lit(0.0)), 6).alias("share"))


QUERIES = {"p10_found": p10_found, "p10_spans": p10_spans, "p10_shared": p10_shared}

_WINDOWS = f"""WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) >= {LENGTH}), w AS (SELECT doc_id, p AS pos, substr(text, p + 1, {LENGTH}) AS s FROM (SELECT *, unnest(range(0, n - {LENGTH - 1})) AS p FROM d)),
twice AS (SELECT s FROM w GROUP BY s HAVING min(doc_id) <> max(doc_id)), hit AS (SELECT DISTINCT doc_id, pos FROM w SEMI JOIN twice USING (s)),
mark AS (SELECT doc_id, pos, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + {LENGTH} THEN 0 ELSE 1 END AS new FROM hit),
run AS (SELECT doc_id, pos, sum(new) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS k FROM mark), span AS (SELECT doc_id, min(pos) AS start, max(pos) + {LENGTH} - min(pos) AS n_chars FROM run GROUP BY doc_id, k)
"""
ORACLES = {
    "p10_found": _WINDOWS + "SELECT DISTINCT doc_id FROM hit",
    "p10_spans": _WINDOWS + "SELECT * FROM span",
    "p10_shared": _WINDOWS
    + """, s AS (SELECT doc_id, CAST(sum(n_chars) AS BIGINT) AS shared_chars, count(*) AS n_spans FROM span GROUP BY 1), a AS (SELECT doc_id, coalesce(length(text), 0) AS n_chars FROM documents)
SELECT doc_id, n_chars, coalesce(shared_chars, 0) AS shared_chars, coalesce(n_spans, 0) AS n_spans, round(coalesce(shared_chars / nullif(n_chars, 0), 0), 6) AS share FROM a LEFT JOIN s USING (doc_id)""",
}
