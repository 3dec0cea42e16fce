"""Text operators on hand-made cases."""
import pytest

from corpuscle.llm import boilerplate as B
from corpuscle.llm import residue as R
from corpuscle.llm import sentences as P
from corpuscle.llm import transcripts as X

MODEL = P.Model({("en", "dr"): False, ("en", "fig"): False, ("en", "u.s"): True, ("en", "e.g"): False, ("de", "z"): False, ("de", "b"): False}, {("de", "Mai")}, {("en", "The")})


def cut(text):
    u = P.units(text, MODEL)
    return [text[a:b].strip() for a, b in zip(u, [*u[1:], len(text)])]


@pytest.mark.parametrize(
    "parts,gap",
    [
        (["Dr. Vane saw Fig. 3 of the file.", "It rose by 9.5 percent on v1.2.", "Was it true?!"], " "),
        (["They moved to the U.S.", "The vote failed."], " "),
        (['"It may fall. Nobody doubts it," said Lee Vane.', "We agree."], " "),
        (["The model... well, it fell.", "We waited for Benar…", "Nothing came."], " "),
        (["A title", "1. First of all.", "2. Second of all.", "And so on the\nline goes."], "\n\n"),
        (["It ended.", "In practice it went on."], ""),
        (["Das gilt z. B. seit dem 23. Mai als sicher.", "Wir nicht."], " "),
        (["准确率上升到90.5%。", "这太快了！", "“它会改变。没有人怀疑。”代表说。"], ""),
        (["クの話だ。", "「それは明らかだ。」と語った。"], ""),
        (["समिति ने कहा कि यह है।", "क्या यह सच है?", "हाँ।"], " "),
        (["คณะกรรมการระบุว่าดี", "คณะกรรมการเตือนว่าไม่ดี"], " "),
        (["Είναι αλήθεια ότι το ξέρει;", "Το δικαστήριο δήλωσε."], " "),
        (["هل هذا صحيح؟", "نعم."], " "),
        (["(The union said otherwise.)", "Yahara! staff agreed."], " "),
    ],
)
def test_units(parts, gap):
    assert cut(gap.join(parts)) == parts


def test_units_edges(spark):
    assert P.units(None, MODEL) == [] and P.units(" \n ", MODEL) == []
    df = spark.createDataFrame([("a", None), ("b", ""), ("c", "One here. Two here."), ("c", "One here. Two here.")], "doc_id string, text string").selectExpr("*", "7 as start_char")
    assert sorted(tuple(r) for r in P.split(df).collect()) == [("c", 0), ("c", 0), ("c", 10), ("c", 10)]
    assert P.split(spark.createDataFrame([], "doc_id string, text string")).count() == 0


def test_more_types_than_a_task_takes(spark, monkeypatch):
    rows = [(str(i), f"Prof. Vane{i} spoke about it. Nobody agreed with Dr. Benar in Fig. {i} of the text. The end came.") for i in range(60)] + [("7", "Prof. Lee."), (None, "Prof. Lee spoke. It ended."), ("n", None)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    want = sorted(tuple(r) for r in P.split(df.where("doc_id is not null")).collect())
    model = P.learn(df)
    monkeypatch.setattr(P, "MAX_TYPES", 1)
    got = [tuple(r) for r in P.split(df, model=model).collect()]
    assert sorted(x for x in got if x[0]) == want and [x for x in got if x[0] is None] == [(None, 0), (None, 17)]


def test_long_words_are_types(spark):
    word = "Donaudampfschifffahrtsges"
    rows = [(str(i), f"Die {word}. in Wien hat das nicht gesagt. Der Rat war dort.") for i in range(20)]
    m = P.Model.of(P.learn(spark.createDataFrame(rows, "doc_id string, text string")).collect())
    assert ("de", word.lower()) in m.abbr


def test_abbreviations_are_learned(spark):
    rows = [(str(i), f"Prof. Vane{i} spoke about it. Nobody agreed with the talk in Fig. {i} of the text. The end came.") for i in range(60)]
    m = P.Model.of(P.learn(spark.createDataFrame(rows, "doc_id string, text string")).collect())
    assert m.abbr.get(("en", "prof")) is False and ("en", "fig") in m.abbr and ("en", "talk") not in m.abbr


PAGE = """Skip to content
Home | News | Press | Contact
We use cookies to improve your visit to Acme. Read our cookie policy.
Accept all

The cost of a long delay

The committee said on Monday that the plan would be dropped after months of talks with the council.
Related: Another story of the week
Subscribe to the idea that models learn like children and the results, 12 in all, look odd.
• Careers for testers at Vane
Advertisement
Nobody at the hearing believed that the second plan could be paid for by the end of the decade.

You may also like
Inside the Vane trial
5 min read
Another short title
© 2024 Acme. All rights reserved."""


def test_article():
    keep = B.article(PAGE, B.Model({}, set()), "acme")
    assert [i for i, k in enumerate(keep) if k] == [5, 7, 9, 10, 12]


def test_pages(spark):
    error = "Home | News | Press\nThe page you asked for does not exist.\nCheck the address and try again.\nSitemap"
    rows = [("p", PAGE, "acme"), ("e", error, None), ("n", None, "acme"), ("b", " \n ", "acme"), ("p", PAGE, "acme")]
    df = spark.createDataFrame(rows, "doc_id string, text string, host string").selectExpr("*", "0 as line_no")
    got = {(r.doc_id, r.line_no) for r in B.furniture(df).collect()}
    assert {i for d, i in got if d == "e"} == {0, 1, 2, 3}
    assert {i for d, i in got if d == "p"} == {0, 1, 2, 3, 8, 11, 14, 15, 16, 17, 18}
    assert {d for d, _ in got} == {"p", "e"}
    assert B.furniture(df.limit(0)).count() == 0


MARKUP = """<nav><ul><li><a href="/">Galleries</a></li><li><a href="/n">Vane news</a></li></ul></nav>
<div class="main">
<h1>The cost of a long delay</h1>
<p>The committee said on Monday that the plan would be <b>dropped</b> after months of talks &amp; a vote.</p>
<p>Nobody at the hearing believed that the second plan could be paid for
by the end of the decade.</p>
<script>var x = "The council met on Monday and agreed on the plan for the river.";</script>
</div>
<div><a href="/a">Tickets</a> <a href="/b">Opening hours</a> <a href="/c">Plan your visit</a></div>
<div><a href="/d">Shops</a></div>
<footer><a href="/i">Imprint</a> | <a href="/t">Terms of use</a></footer>"""


def test_markup_counts_as_tags(spark):
    lines, tags = B.visible('<ul><li><a href="x">One</a></li></ul>\n<p>A plain sentence of running text.</p>')
    d = B.densities(lines, tags, [False, False])
    assert lines[0] == "One" and d[1] > 5 * d[0]
    keep = B.article(MARKUP, B.Model({}, set()), "acme")
    assert [i for i, k in enumerate(keep) if k] == [2, 3, 4, 5]
    df = spark.createDataFrame([("p", MARKUP, "acme"), ("q", "A title\nIf a < b and b > c, the council said, then the plan of the town is to be dropped at last.", "acme")], "doc_id string, text string, host string")
    got = {(r.doc_id, r.line_no) for r in B.furniture(df).collect()}
    assert got == {("p", i) for i in (0, 1, 6, 7, 8, 9, 10)}


def test_regions_decide(monkeypatch):
    args = PAGE, B.Model({}, set()), "acme"
    kept = B.article(*args)
    n = sum(bool(x.strip()) for x in PAGE.split("\n"))
    monkeypatch.setattr(B, "regions", lambda r: r >= 0)
    assert sum(B.article(*args)) > n - 4 > sum(kept)
    monkeypatch.setattr(B, "regions", lambda r: r < 0)
    assert not any(B.article(*args))


@pytest.mark.parametrize(
    "text,want",
    [
        ("{{ title }}\n${company} today announced %%PRODUCT%%, a new platform for [CITY HERE].", "residue"),
        ("Dear {{ name }},\n\nThank you for your interest in <%= city %> and our work.\n\nKind regards", "residue"),
        ("Lorem ipsum dolor sit amet culpa. Magna aliqua sed do elit quis.", "residue"),
        ("asdf qwer foo bar test xxx", "residue"),
        ("404 Not Found\n\nThe requested URL /a/1 was not found on this server.", "residue"),
        ("Please enable JavaScript to run this app.", "residue"),
        ("Seite nicht gefunden\nDie angeforderte Seite existiert nicht mehr. Fehlercode 403", "residue"),
        ("お探しのページは見つかりませんでした。\nエラー 404", "residue"),
        ("Designers at Vane had left lorem ipsum in the draft policy, a lapse that cost 9 staff hours.", "content"),
        ("The template used the slots {{user}} and {{claim}}, which the model filled in 78 of the trials at Vane.", "content"),
        ("Access was denied to 12 researchers who asked Vane for the weights of the model.", "content"),
        ("The committee met on Monday and agreed on a plan.\n\nPlease enable JavaScript to view the comments.", "content"),
        ("Short title", "none"),
    ],
)
def test_judge(text, want):
    assert R.judge(text) == want


def test_weak_texts_need_repetition_across_hosts(spark):
    rows = [(f"d{i}", f"Login Vane{i}", f"h{i % 2}") for i in range(4)] + [("x", "Login elsewhere twice", "h0"), ("n", None, None), ("ok", "The committee met on Monday and agreed.", "h1")]
    df = spark.createDataFrame(rows, "doc_id string, body string, host string").selectExpr("*", "1 as verdict")
    assert {r.doc_id for r in R.verdicts(df).collect()} == {"d0", "d1", "d2", "d3"}
    assert R.verdicts(df.limit(0)).count() == 0


def test_new_phrasing_is_found_by_its_words_and_returns(spark):
    known = ["The page you asked for was not found. Check the address and try again.", "This page does not exist. Check the address you typed.", "Sorry, the page you want has moved. Try the address again.", "We looked at that address, but the page was not found.", "You will have to try another one, this page does not exist."]
    new = "We looked for the page at that address, but you will have to try another one."
    assert R.judge(new) == "content"
    rows = [(f"k{i}", known[i % 5], f"h{i % 4}") for i in range(30)]
    rows += [(f"c{i}", f"The council of Vane{i} met on Monday and agreed on a plan for the river.", f"h{i % 5}") for i in range(60)]  # repeats, but is no message
    rows += [(f"w{i}", f"We waited, then tried again to look for Vane{i}.", f"h{i}") for i in range(4)]  # some words of messages
    rows += [(f"l{i}", f"The plan of Vane{i} was agreed on by the council of the river on Monday in the end.\n{new}", f"h{i}") for i in range(4)]  # a first line that is no title
    rows += [(f"n{i}", new, f"h{i}") for i in range(3)] + [("once", "You may want to try the other page at the address again, it is the one we looked for.", "h1")]
    got = {r.doc_id: r.signal for r in R.verdicts(spark.createDataFrame(rows, "doc_id string, body string, host string")).collect()}
    assert got == {**{f"k{i}": "detector" for i in range(30)}, **{f"n{i}": "hosts" for i in range(3)}}


def names(text):
    return [(i, who) for i, who, _ in X.turns(text)]


def test_turns_layouts():
    assert names("Recorded at Vane\n[00:00:05] Ana Vane (Chair): Hello there.\nAnd so, more.\n[00:00:20] OPERATOR: Next.\n[00:00:10] A. Vane: [laughter] um, uh...\n[00:00:12] VANE: Again.") == [(1, "vane"), (3, "operator")]
    assert names("Vane, Ana  (0:01)\n[laughter]\n\nKofi Tarr (Analyst)  (0:44)\nYes, we did.\n\nVANE  (1:10)\nGood.") == [(4, "tarr"), (7, "vane")]
    assert names("00:00:01.000 --> 00:00:02.000\n<v Ana Vane>First.\n\n00:00:03.000 --> 00:00:04.000\n<v Dr. Tarr>Second.\n\n00:00:05.000 --> 00:00:06.000\n<v Ana>Third.") == [(1, "vane"), (4, "tarr"), (7, "vane")]
    assert names("SPEAKER_03 00:10 Late.\nSpk 2 00:05 Early.\nspeaker2 00:07 Uh.") == [(1, "speaker 2"), (0, "speaker 3")]
    assert names(">> Ana Vane: One.\n>> Moderator: (laughs)\n>> Vane: Two.\n>> Tarr: Three.") == [(0, "vane"), (3, "tarr")]
    assert names("Participants: Ana Brandine, Kofi Tarreman\nANA BRANDINE — One.\nTarreman — Two.\nBranddine — Three.") == [(1, "brandine"), (2, "tarreman"), (3, "brandine")]


def test_participants_count_wherever_they_stand():
    talk = [">> Ada: One.", ">> Grace: Two."]
    for at in (0, 7, 40):
        lines = [f"Recorded at Vane, part {i}." for i in range(at)] + ["Participants: Ada Lovelace, Grace Hopper", "", *talk]
        assert names("\n".join(lines)) == [(at + 2, "lovelace"), (at + 3, "hopper")]


def test_prose_has_no_turns():
    assert names("The board met on Monday. Nobody agreed.\nCorrection: During the trial, spending grew.\nNote: More follows.") == []
    assert names(None or "") == [] and names("  \n") == []


def test_shared_first_names_are_resolved_by_language():
    talk = ["rates inflation bonds yields markets", "robots sensors motors gears arms"]
    lines = []
    for i in range(12):
        lines.append(f"[00:{i * 2:02}:00] Ana Vane: the {talk[0]} and {talk[0]}")
        lines.append(f"[00:{i * 2 + 1:02}:00] Ana Torrel: the {talk[1]} and {talk[1]}")
    lines += ["[00:40:00] Host: So.", f"[00:41:00] Ana: the {talk[1]} again", "[00:42:00] Host: So.", f"[00:43:00] Ana: the {talk[0]} again"]
    assert names("\n".join(lines))[-4:] == [(24, "host"), (25, "torrel"), (26, "host"), (27, "vane")]


def test_extract(spark):
    df = spark.createDataFrame([("a", ">> Ana Vane: One.\n>> Tarr: Two."), ("b", None), ("c", "")], "doc_id string, text string").selectExpr("*", "'x' as speaker")
    assert sorted((r.doc_id, r.turn_no, r.line_no, r.speaker, r.speech) for r in X.extract(df).collect()) == [("a", 0, 0, "vane", "One."), ("a", 1, 1, "tarr", "Two.")]
    assert X.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("unit", ["One more sentence is here. ", "1. Item here.\n", '"', "“x ", "a", " ", "\n", "Ana: hi\n", "[00:00:01] Ana Vane: hi\n", "{{x}} ", "lorem ipsum ", "ไทย "])
def test_very_long_texts(unit):
    import time

    text = unit * (100_000 // len(unit))
    began = time.time()
    assert P.units(text, MODEL) is not None
    R.judge(text)
    X.turns(text)
    B.article(text, B.Model({}, set()), "acme")
    assert time.time() - began < 60
