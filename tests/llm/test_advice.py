"""Cases of the review: what the operators once left out."""
import math
from collections import Counter
from itertools import pairwise, product

from corpuscle.llm import boilerplate as B
from corpuscle.llm import residue as R
from corpuscle.llm import sentences as P
from corpuscle.llm import transcripts as X


def corpus(spark, path, rows):
    spark.createDataFrame(rows, "doc_id string, text string, actor string, platform string").write.parquet(f"{path}/corpus.parquet")
    return str(path)


def test_learned_notices_do_not_hide_error_pages(spark, tmp_path):
    notice = "Our pages remember a few choices of yours between visits."
    gone = "The page you asked for does not exist."
    rows = [(f"c{i}", f"{notice}\nTitle {i}\nThe council of town {i} met on Monday and agreed on plan {i} for the river.", f"h{i % 3}", "blog") for i in range(12)]
    rows += [(f"e{i}", f"{notice}\n{gone}\nCheck the address and try again.", f"h{i}", "blog") for i in range(6)]
    rows += [("s", f"{notice}\nPage not found", "h0", "Blog"), ("x", None, None, "blog")]
    assert {r.doc_id for r in R.p4_found(spark, corpus(spark, tmp_path, rows)).collect()} == {"s", *(f"e{i}" for i in range(6))}


def test_starters_count_over_the_corpus_not_the_batch(spark):
    rows = [(str(i), "The talk with Vane on the plan left a gap. The council did not agree with Benar.") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id string, text string").coalesce(1)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, models = spark.conf.get(key), []
    try:
        for n in ("1", "10000"):
            spark.conf.set(key, n)
            models.append(P.Model.of(P.learn(df).collect()))
    finally:
        spark.conf.set(key, before)
    assert vars(models[0]) == vars(models[1]) and ("en", "gap") not in models[0].abbr


def test_starters_and_collocations_by_likelihood(spark):
    rows = [(str(i), f"The end of the plan by Vane{'.' if i % 3 else '?'} The talk of Vane with Benar went on in the U.S. Senate in May. It was odd. We left the U.S. The vote on it failed.") for i in range(60)]
    rows += [(f"v{i}", "Vane met the council and the people of the town on that day with Benar.") for i in range(8)]
    m = P.Model.of(P.learn(spark.createDataFrame(rows, "doc_id string, text string")).collect())
    assert ("en", "The") in m.starters and ("en", "Vane") not in m.starters
    assert m.abbr.get(("en", "u.s")) is None or ("en", "u.s", "The") not in m.pairs


def test_starters_split_after_abbreviations_and_pairs_do_not():
    m = P.Model({("en", "etc"): False, ("en", "u.s"): True}, set(), {("en", "The")}, {("en", "u.s", "Senate")})
    text = "They sold pens, ink, etc. The vote in the U.S. Senate failed in the U.S. Nobody saw etc. Vane."
    assert [text[a : a + 6] for a in P.units(text, m)] == ["They s", "The vo", "Nobody"]


def test_language_is_chosen_per_paragraph():
    m = P.Model({}, set(), set())
    latin = "The council of the town met on Monday and agreed on the plan for the river. " * 30
    for tail, unit in (("คณะกรรมการระบุว่าดี คณะกรรมการเตือนว่าไม่ดี", "คณะกรรมการเตือน"), ("准确率上升到九成。这太快了！", "这太快"), ("समिति ने कहा कि यह है।क्या यह सच है?", "क्या")):
        for text in (latin + "\n\n" + tail, tail + "\n\n" + latin):
            assert text.index(unit) in P.units(text, m)
            assert len(P.units(text, m)) == 32
    assert len(P.units("Είναι αλήθεια ότι το ξέρει; Το δικαστήριο δήλωσε.\n\n" + latin.replace("town met", "town; That met"), m)) == 32


def test_paragraphs_far_from_the_regions_are_furniture():
    body = ["The committee said on Monday that the plan would be dropped after months of talks with the council of the town." * 2] * 4
    foot = ["Careers", "Team", "Our offices are open on all days of the week.", "Events", "Awards"]
    keep = B.article("\n".join(["A title", *body, "Press", "Partners", "People", *foot]), B.Model({}, set()), "acme")
    assert [i for i, k in enumerate(keep) if k] == [0, 1, 2, 3, 4]


LONG_NOTICE = "We use cookies to improve your visit to Acme, " + "to count how often our pages are read and to show what fits your interests, " * 2 + "as our policy tells."


def test_long_notices_are_furniture(spark, tmp_path):
    other = "Readers who come back to these pages find that their chosen size of type and their place in a text are remembered " * 2 + "for them."
    gone = "The page you asked for does not exist."
    rows = [(f"c{i}", f"{other}\nTitle {i}\nThe council of {chr(97 + i) * 4} met on Monday and agreed on a plan for the river.", f"h{i % 3}", "blog") for i in range(12)]
    rows += [("e", f"{other}\n{gone}", "h1", "blog"), ("f", f"{LONG_NOTICE}\n{gone}", "h1", "blog"), *[("r", f"A title\n{other[:200]} by and by.", "h2", "blog")] * 9]
    sf = corpus(spark, tmp_path, rows)
    got = {(r.doc_id, r.line_no) for r in B.p1_found(spark, sf).collect()}
    assert got == {*((f"c{i}", 0) for i in range(12)), ("e", 0), ("e", 1), ("f", 0), ("f", 1)}
    assert {r.doc_id for r in R.p4_found(spark, sf).collect()} == {"e", "f"}


def test_articles_of_error_pages_are_empty(spark, tmp_path):
    rows = [("e", "Home | News | Press\nThe page you asked for does not exist.\nSitemap", "h", "blog"), ("c", "Home | News | Press\nThe council met on Monday and agreed on a plan for the river.", "h", "blog")]
    got = {r.doc_id: r.article for r in B.p1_articles(spark, corpus(spark, tmp_path, rows)).collect()}
    assert got == {"e": "", "c": rows[1][1].split("\n")[1]}


def test_weak_messages_of_one_host_under_other_titles(spark):
    talks = ["Robots of Vane", "Bridges under water", "Prices in spring", "Trains at night"]
    rows = [(f"d{i}", f"{t}\nLogin needed, members only", "h") for i, t in enumerate(talks)] + [(f"n{i}", f"Login Vane{i}", h) for i, h in enumerate(["a", None, None])]
    rows += [(f"m{i}", f"Members of {t}\nMembers at the gate", "h") for i, t in enumerate(talks)]
    df = spark.createDataFrame(rows, "doc_id string, body string, host string")
    assert {r.doc_id for r in R.verdicts(df).collect()} == {"d0", "d1", "d2", "d3", "n0", "n1", "n2"}


def who(text, line):
    return next(w for i, w, _ in X.turns(text) if i == line)


def at(n, rest):
    return f"[{n // 60:02}:{n % 60:02}:00] {rest}"


def test_the_model_runs_in_order_of_time_not_of_the_file():
    lines = []
    for i in range(8):  # Tarr is answered by Vane, Benar by Torrel
        lines += [at(4 * i, "Kofi Tarr: Yes."), at(4 * i + 1, "Ana Vane: Yes."), at(4 * i + 2, "Lee Benar: Yes."), at(4 * i + 3, "Ana Torrel: Yes.")]
    lines += [at(40, "Kofi Tarr: Yes."), at(43, "Ana: Yes."), at(42, "Lee Benar: Yes.")]  # in the file after Tarr, in time after Benar
    assert who("\n".join(lines), 33) == "torrel"


def test_an_utterance_without_a_word_is_no_step_of_the_model():
    lines = []
    for _ in range(8):
        lines += [">> Kofi Tarr: Yes.", ">> Ana Vane: Yes.", ">> Lee Benar: Yes.", ">> Ana Torrel: Yes."]
    lines += [">> Kofi Tarr: Yes.", ">> Lee Benar: [laughter] um", ">> Ana: Yes."]
    assert who("\n".join(lines), 34) == "vane"


def test_lines_without_a_label_are_evidence_of_their_speaker():
    talk = {"Vane": "rates inflation bonds yields markets", "Torrel": "robots sensors motors gears arms"}
    lines = []
    for i in range(6):  # all that tells them apart stands in lines with a stamp and no label
        for k, (name, said) in enumerate(talk.items()):
            lines += [at(6 * i + 3 * k, f"Ana {name}: Yes."), at(6 * i + 3 * k + 1, said), at(6 * i + 3 * k + 2, "Host: So.")]
    for k, said in enumerate((talk["Torrel"], talk["Vane"])):
        lines += [at(40 + 3 * k, "Ana: Yes."), at(41 + 3 * k, said), at(42 + 3 * k, "Host: So.")]
    text = "\n".join(lines)
    assert [who(text, 36), who(text, 39)] == ["torrel", "vane"]


def test_roles_initials_and_misspellings_that_fit_several_are_hidden_states():
    talk = ["rates inflation bonds yields markets", "robots sensors motors gears arms"]
    for names, label in (
        (("Kofi Tarr (Analyst)", "Lee Benar (Analyst)"), "Analyst"),
        (("Kofi Tarr", "Karin Benar"), "K."),
        (("Kofi Hansen", "Lee Hangon"), "Hanson"),
    ):
        lines = []
        for _ in range(6):
            lines += [f">> {names[0]}: {talk[0]}", ">> Host: So.", f">> {names[1]}: {talk[1]}", ">> Host: So."]
        lines += [f">> {label}: {talk[1]}", ">> Host: So.", f">> {label}: {talk[0]}"]
        first, second = (X.Label(n).family for n in names)
        text = "\n".join(lines)
        assert [who(text, 24), who(text, 26)] == [second, first], label
    assert who(">> Kofi Tarr: Yes.\n>> Moderator: So.\n>> Q: No.", 1) == "moderator"
    assert who(">> Kofi Tarr: Yes.\n>> Moderator: So.\n>> Q: No.", 2) == "q"


def test_the_sequence_is_the_most_probable_one():
    """All sequences of a small transcript, weighed by the definition: proper probabilities, of all words."""
    said = ["a b c a b d e", "f g h", "a f c", "b g d f", "f f h a", "c d b", "h g a", "a b f e e", "g d", "a c f h"]
    for mask in product((False, True), repeat=5):
        free = {3, 6} | {k for k, m in zip((2, 4, 5, 7, 9), mask) if m}
        segs = [{"label": None, "t": None, "parts": [(k, x)], "said": [(k, x)]} for k, x in enumerate(said)]
        cands = [["p", "q"] if k in free else ["pqr"[k % 3]] for k in range(len(said))]
        trans = Counter((a[0], b[0]) for a, b in pairwise(cands) if len(a) == len(b) == 1)
        names = sorted({n for c in cands for n in c})
        spoken = Counter(" ".join(said).split())
        own = {n: Counter(w for x, c in zip(said, cands) if c == [n] for w in x.split()) for n in names}
        weight = {n: {x: own[n][x] + 0.5 + len(spoken) * spoken[x] / sum(spoken.values()) / 2 for x in spoken} for n in names}
        step = {a: {b: trans[a, b] + (0.2 if a == b else 1) for b in names} for a in names}

        def score(path):
            moves = sum(math.log(step[a][b] / sum(step[a].values())) for a, b in pairwise(path))
            return moves + sum(math.log(weight[n][w] / sum(weight[n].values())) for n, x in zip(path, said) for w in x.split())

        best = max(map(score, product(*cands)))
        assert math.isclose(score(X.resolve(segs, cands)), best)
