"""Operators against brute force, round trips and held-out cases on small fixtures."""
import random

import numpy as np
import pandas as pd
import pytest

from corpuscle.llm import consensus, encoding, packing, quota, spans

VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"


# -- encoding
TEXTS = ["", " ", "a", "hello world", "  two  blanks\n\n\tand tabs ", "don't won't they'll I'd", "<|endoftext|> is text", "naïve café 东京 한국 ไทย हिन्दी", "x" * 5000, "🤖🤖 ​﻿ \u0000\u0001", "1234567890" * 40, "ÄÖÜ ß ¿¡«»", "\r\n\r\n", "a" * 3 + " " * 700]


def test_encoding_matches_libraries(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    rng = random.Random(1)
    texts = TEXTS + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 900), rng.randrange(0x3040, 0x30FF)])) for _ in range(60)) for _ in range(200)]
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)] + [(-1, None)], "doc_id bigint, text string").selectExpr("*", "1 as ids")
    got = {r.doc_id: r.ids for r in encoding.encode(df, "doc_id", "text").collect()}
    assert got[-1] == [] and got[0] == []
    assert [got[i] for i in range(len(texts))] == want
    n = {r.doc_id: r.n_tokens for r in encoding.token_counts(df, "doc_id", "text").collect()}
    assert n[-1] == 0 and all(n[i] == len(w) for i, w in enumerate(want))


def test_speculation_is_verified_exactly():
    v = encoding.vocabulary()
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdeinorst'éß漢") for _ in range(rng.randrange(1, 14))) for _ in range(3000)]
    assert v.encode_words(words) == [encoding.merge(w.encode(), v.ranks) for w in words]
    assert any(v.propose(w.encode()) != encoding.merge(w.encode(), v.ranks) for w in words)


# -- packing
def test_packing(spark):
    rng = random.Random(4)
    sizes = [rng.randrange(0, 60) for _ in range(400)] + [250, 100, 200, 0, None]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id bigint, n_tokens bigint").selectExpr("*", "'x' as bin")
    rows = packing.pack(df, "doc_id", "n_tokens", 100).collect()
    whole = {}
    used = {}
    for r in rows:
        whole[r.doc_id] = whole.get(r.doc_id, 0) + r.n
        used[r.bin] = used.get(r.bin, 0) + r.n
    assert whole == {i: n or 0 for i, n in enumerate(sizes)}
    assert max(used.values()) <= 100
    assert all((sizes[r.doc_id] or 0) > 100 or r.piece == 0 for r in rows)  # only what exceeds a container is split
    assert len(used) <= -(-sum(used.values()) // 100) + 1


def test_fullest_is_exact():
    rng = random.Random(5)
    for _ in range(150):
        counts = {rng.randrange(1, 15): rng.randrange(1, 4) for _ in range(5)}
        room = rng.randrange(1, 40)
        best = {0}
        for s, n in counts.items():
            best |= {b + s * k for b in best for k in range(1, n + 1)}
        got = packing.fullest(counts, sorted(counts, reverse=True), room)
        assert sum(s * k for s, k in got) == max(b for b in best if b <= room)
        assert all(k <= counts[s] for s, k in got)


def test_packing_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, n_tokens bigint")
    assert packing.pack(df, "doc_id", "n_tokens", 10).count() == 0


# -- shared spans
def brute_windows(docs, length):
    where = {}
    for d, t in docs:
        for i in range(len(t or "") - length + 1):
            where.setdefault(t[i : i + length], set()).add(d)
    return {(d, i) for d, t in docs for i in range(len(t or "") - length + 1) if len(where[t[i : i + length]]) > 1}


def test_shared_windows_match_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    rand = lambda n: "".join(rng.choice("abcdefgh \n漢🤖") for _ in range(n))
    common = [rand(n) for n in (39, 40, 41, 90, 200)]
    docs = [(i, rand(rng.randrange(0, 150)) + (rng.choice(common) if i % 3 else "") + rand(rng.randrange(0, 150))) for i in range(60)]
    docs += [(100, "x" * 300), (101, "x" * 60), (102, "y" * 300), (103, None), (104, ""), (105, common[2] * 2), (106, docs[3][1]), (107, docs[3][1])]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as pos").repartition(3)
    got = {(r.doc_id, r.pos) for r in spans.repeated_windows(df, "doc_id", "text", 40, 13).collect()}
    assert got == brute_windows(docs, 40)
    for name in ("BROADCAST", "LOCAL", "HELD"):  # beyond its bound each step has another way
        monkeypatch.setattr(spans, name, 1)
    monkeypatch.setattr(spans, "RANGE", 256)
    full = spans.repeated_windows(df, "doc_id", "text", 40, 13, max_bits=1)  # a folded sketch that rules out nothing
    assert {(r.doc_id, r.pos) for r in full.collect()} == got
    assert spans.repeated_windows(df.where("doc_id < 0"), "doc_id", "text").count() == 0
    total = {r.doc_id: 0 for r in df.collect()}
    for r in spans.spans(spans.shared_runs(df, "doc_id", "text", 40, 13), "doc_id", 40).collect():
        total[r.doc_id] += r.n_chars
    want = {d: len({j for dd, i in got if dd == d for j in range(i, i + 40)}) for d in total}
    assert total == want


def test_long_texts_are_chunked(monkeypatch, spark):
    monkeypatch.setattr(spans, "CHUNK", 500)
    rng = random.Random(7)
    t = "".join(rng.choice("abcdefgh") for _ in range(3000))
    u = "".join(rng.choice("ijklmnop") for _ in range(700)) + t[450:1700]
    got = set()
    for codes, rows, offs, starts in spans._chunks([t, u], 40):
        ends = np.append(starts[1:], len(codes))
        for r, o, s, e in zip(rows, offs, starts, ends):
            got |= {(int(r), int(o) + i) for i in range(e - s - 39)}
    assert got == {(0, i) for i in range(len(t) - 39)} | {(1, i) for i in range(len(u) - 39)}


# -- quotas
def test_allocation():
    rows = pd.DataFrame({"target_id": [1, 2, 3], "target_pm": [600, 395, 5], "min_rows": [1, 1, 5], "available": [100, 10, 50]})
    q = quota.allocate(rows, 50)
    assert sum(q) == 50 and q[1] <= 10 and q[2] >= 5
    assert sum(quota.allocate(rows.assign(available=3), 50)) == 9  # nothing left to take


def one_by_one(rows, size):
    """Quotas with one row moved at a time."""
    cap, want = rows["available"].tolist(), [pm * size for pm in rows["target_pm"].tolist()]
    floor = [min(m, c) for m, c in zip(rows["min_rows"].tolist(), cap)]
    q = [min(c, max(f, w // 1000)) for f, w, c in zip(floor, want, cap)]
    while sum(q) > size and any(a > b for a, b in zip(q, floor)):
        q[max((1000 * q[i] - want[i], -i) for i in range(len(q)) if q[i] > floor[i])[1] * -1] -= 1
    while sum(q) < size and any(a < b for a, b in zip(q, cap)):
        q[max((want[i] - 1000 * q[i], -i) for i in range(len(q)) if q[i] < cap[i])[1] * -1] += 1
    return q


def test_allocation_equals_moving_rows_one_by_one():
    rng = random.Random(9)
    for _ in range(400):
        n = rng.randrange(1, 8)
        cuts = sorted(rng.randrange(0, 1001) for _ in range(n - 1))
        rows = pd.DataFrame({"target_id": range(n), "target_pm": [b - a for a, b in zip([0, *cuts], [*cuts, 1000])], "min_rows": [rng.randrange(0, 30) for _ in range(n)], "available": [rng.choice([0, 5, 50, 400]) for _ in range(n)]})
        size = rng.randrange(0, 300)
        assert quota.allocate(rows, size) == one_by_one(rows, size)
    big = pd.DataFrame({"target_id": [1, 2], "target_pm": [900, 100], "min_rows": [0, 0], "available": [10, 10**12]})
    assert quota.allocate(big, 10**11) == [10, 10**11 - 10]


def test_sample_follows_quotas(spark):
    docs = spark.createDataFrame([(f"d{i}", "policy" if i % 4 else "public", "a", 0) for i in range(2000)], "doc_id string, context string, actor string, post int")
    t = spark.createDataFrame([(1, "p", 10, "Policy ", None, None, 300, 5), (2, "p", 10, "public", None, None, 700, 5), (3, "q", 1, "commercial", None, None, 1000, 2)],
                              "target_id int, plan string, sample_pct int, context string, actor string, post_chatgpt smallint, target_pm int, min_rows int")
    rep = quota.report(docs, t)
    met = {r.target_id: (r.quota, r.met) for r in rep.collect()}
    assert met[1] == (60, True) and met[2] == (140, True) and met[3] == (0, False)
    s = quota.draw(docs, t, rep).toPandas()
    assert s.groupby("target_id").doc_id.nunique().to_dict() == {1: 60, 2: 140}
    again = quota.draw(docs.repartition(7), t, rep).toPandas()
    assert set(map(tuple, s.values)) == set(map(tuple, again.values))


def test_eligible_names(spark):
    c = spark.createDataFrame([("1", "\tACME  Labs", "Public ", 1), ("1", "acme labs", "public", 1), ("2", "acme labs", "n/a", 1), ("3", None, "public", 1), ("4", "Acme Labs", "policy", None), ("5", "Other", "policy", 0)],
                              "doc_id string, actor string, context string, post_chatgpt smallint")
    d = spark.createDataFrame([("Acme Labs",)], "actor string")
    assert [tuple(r) for r in quota.eligible(c, d).collect()] == [("1", "public", "acme labs", 1)]


# -- consensus
def test_parse_notations():
    want = {"Innovation/Progress": {"A": 1, "B": 0, "C": 1}, "None": {"A": 0, "D": 1}}
    for s in ("Innovation/Progress: A=1 B=0 C=1; None: A=0 D=1", "innovation_progress: a:1, b:0, c:1, | none: a:0, d:1 e:", "Innovation / Progress: A = 1.0, B = 0, E= , C=1, A=1 ; None: A=0 D=1 F=nan G=x"):
        assert consensus.parse(s) == want
    assert consensus.parse("Economic Benefit: J= A=1 B=0") == {"Economic Benefit": {"A": 1, "B": 0}}
    assert consensus.parse(None) == {} and consensus.parse("???") == {}


def test_consensus_beats_majority(spark):
    rng = np.random.default_rng(8)
    skill = {"A": (0.95, 0.03), "B": (0.93, 0.05), "C": (0.9, 0.06), "F": (0.9, 0.4), "G": (0.3, 0.35), "I": (0.1, 0.8)}
    rows, truth = [], {}
    for i in range(1500):
        lab = {x: int(rng.random() < 0.2) for x in consensus.LABELS[:5]}
        lab["None"] = int(not any(lab.values()))
        who = sorted(rng.choice(list(skill), size=rng.integers(3, 6), replace=False))
        parts = []
        for x in consensus.LABELS:
            v = {a: int(rng.random() < skill[a][0 if lab[x] else 1]) for a in who}
            if len(set(v.values())) > 1:
                parts.append(f"{x}: " + " ".join(f"{a}={b}" for a, b in v.items()))
                truth[f"s{i}", x] = (lab[x], int(sum(v.values()) * 2 > len(v)))
        if parts:
            rows.append((f"s{i}", "; ".join(parts), None))
    df = spark.createDataFrame(rows + rows[:20] + [(None, "None: A=1 B=0", 1), ("empty", None, 3)], "sentence_id string, disagreements string, n_disagreements int")
    sents = consensus.sentences(df)
    model = consensus.fit(sents)
    got = {(r.sentence_id, r.label): int(r.p > 0.5) for r in consensus.posteriors(sents, model).where("listed").collect()}
    assert set(got) == set(truth)
    ours = np.mean([got[k] == truth[k][0] for k in truth])
    majority = np.mean([truth[k][1] == truth[k][0] for k in truth])
    assert ours > 0.9 and ours > majority + 0.1
    k = {r.label: r for r in consensus.agreement(consensus.posteriors(sents, model)).collect()}
    assert all(r.kappa is None or r.kappa <= 1 for r in k.values())


def test_many_annotators_take_memory_by_votes(spark):
    rows = [(f"s{i}", f"Risk/Harm: A{i}=1 B{i % 7}=1 C{i % 5}=0; None: A{i}=0 B{i % 7}=0 C{i % 5}=1") for i in range(20_000)]
    s = consensus.sentences(spark.createDataFrame(rows, "sentence_id string, disagreements string"))
    names, prior, conf = consensus.fit(s, max_steps=4)
    assert len(names) == 20_012 and conf.shape == (20_012, 2)
    got = consensus.posteriors(s, (names, prior, conf)).where("listed")
    assert got.count() == 40_000 and got.where("n_votes <> 3 or n_annotators <> 3").count() == 0


def test_consensus_empty(spark):
    df = spark.createDataFrame([], "sentence_id string, disagreements string, n_disagreements int")
    s = consensus.sentences(df)
    assert consensus.posteriors(s, consensus.fit(s)).count() == 0
