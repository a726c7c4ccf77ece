import random

import numpy as np
import planted
import pytest

from marlgraph.llm import pii
from marlgraph.llm.pii_grammar import Names, candidates
from marlgraph.llm.tagger import Tagger

CONTACTS = [(g, f) for g in ("Alwena", "Jörun", "Runa", "Tove", None) for f in ("Brockbley", "Brocketti", "Brockwick", "Drayetti", "Drayovac", "Draywick", "Fennbley", "Fennovac", "Fennwick", "Ströetti", "Ströovac")]
NAMES = Names(CONTACTS)


@pytest.mark.parametrize(
    "text, kind, want",
    [
        ("Mail runa.drayovac@mail.koltas.test once", "email", "runa.drayovac@mail.koltas.test"),
        ("to <Runa.DRAYOVAC@MAIL.TEST>", "email", "Runa.DRAYOVAC@MAIL.TEST"),
        ("cc tove (at) corp (dot) umbra (dot) example.", "email", "tove (at) corp (dot) umbra (dot) example"),
        ("a.b [at] c [dot] example ok", "email", "a.b [at] c [dot] example"),
        ("My mobile is +44 7700 900730, try", "phone", "+44 7700 900730"),
        ("Call (404) 555 0134 before", "phone", "(404) 555 0134"),
        ("Tel.: 030/23125-658", "phone", "030/23125-658"),
        ("tel. 500 000 081", "phone", "500 000 081"),
        ("SSN 953-15-0301 was typed", "id_number", "953-15-0301"),
        ("Her passport no. is QQ 11 18 58 C.", "id_number", "QQ 11 18 58 C"),
        ("Steuer-ID 02 672 202 209 liegt vor", "id_number", "02 672 202 209"),
        ("DNI 0.000.211-P del conductor", "id_number", "0.000.211-P"),
        ("lives at 83b Saltbeck Rd. Next", "street_address", "83b Saltbeck Rd"),
        ("wohnt jetzt Lindenwehrstraße 234", "street_address", "Lindenwehrstraße 234"),
        ("Livrer au 80, rue du Vieux Tamarin.", "street_address", "80, rue du Vieux Tamarin"),
        ("en Avenida del Faro Hundido, 117.", "street_address", "Avenida del Faro Hundido, 117"),
        ("Escalated to Dr. Corvin Brockovac today", "person_name", "Corvin Brockovac"),
        ("Frau Drayetti, Tove hat", "person_name", "Drayetti, Tove"),
        ("Ask B. Ströwick, not", "person_name", "B. Ströwick"),
        ("by RUNA DRAYETTI and", "person_name", "RUNA DRAYETTI"),
        ("von Tove H. Fennetti-Brockwick.", "person_name", "Tove H. Fennetti-Brockwick"),
    ],
)
def test_exact_forms(text, kind, want):
    assert [(k, text[a:b]) for a, b, k in candidates(text, NAMES)] == [(kind, want)]


@pytest.mark.parametrize(
    "text",
    ["Range +14 17 121 mm is within limits", "Build 1.624.037.9219 runs", "Serial C9X00LK94 sits in bin 691-09-1613.", "SSN column dropped from EKPO on 2024-04-11", "passport no. missing, ask again", "Draywick Pumps confirmed", "Old Heronry Street gate A", "mention @plant-74 and set qty@327", "path A > B @ node 5", "Dear team, thanks", "", "Drayquell Filters 632-3747-428 fits."],
)
def test_nothing_personal(text):
    assert candidates(text, NAMES) == []


def test_gradients():
    rng = np.random.default_rng(0)
    t = Tagger(5, hidden=4, size=3)
    for k in t.p:
        t.p[k] = t.p[k].astype(np.float64) + rng.standard_normal(t.p[k].shape) * 0.1
    x, y, m = rng.integers(1, 90, (7, 3)), rng.integers(0, 5, (7, 3)), np.ones((7, 3))
    m[5:, 1], x[5:, 1], y[5:, 1] = 0, 0, 0
    _, g = t.gradients(x, y, m)
    for k in t.p:
        i = (int(x[2, 0]), 1) if k == "E" else tuple(int(rng.integers(0, n)) for n in t.p[k].shape)
        old, e = t.p[k][i], 1e-3
        t.p[k][i] = old + e
        up = t.gradients(x, y, m)[0]
        t.p[k][i] = old - e
        down = t.gradients(x, y, m)[0]
        t.p[k][i] = old
        assert abs((up - down) / 2 / e - g[k][i]) < 2e-3 + 0.02 * abs(g[k][i]), k


def corpus(seed, n):
    rnd = random.Random(seed)
    people = [(g, f) for g, f in CONTACTS if g]
    plain = ["Stock of MAT-%d fell to %d PC.", "Charge %d lagert in P0%d.", "Order %d waits for %d units.", "Build 1.%d.037.92%d runs."]
    texts = []
    for _ in range(n):
        parts = [rnd.choice(plain) % (rnd.randrange(10**6), rnd.randrange(99)) for _ in range(rnd.randrange(1, 6))]
        for _ in range(rnd.randrange(0, 3)):
            g, f = rnd.choice(people)
            parts.insert(rnd.randrange(len(parts) + 1), rnd.choice([f"Ask {g} {f}, not the hotline.", f"Mail {g.lower()}.{f.lower()}@corp.example now.".replace("ö", "o"), f"My mobile is +44 7700 900{rnd.randrange(100, 999)}, try.", f"SSN 9{rnd.randrange(10, 99)}-15-0{rnd.randrange(100, 999)} was typed.", f"Ship to {rnd.randrange(1, 200)} Saltbeck Road."]))
        texts.append(" ".join(parts))
    return texts


@pytest.fixture(scope="module")
def recogniser():
    return pii.Recogniser(pii.fit(corpus(1, 400), CONTACTS, steps=120, rounds=5))


def test_held_out_recall(recogniser):
    texts = corpus(2, 200)
    gold = [candidates(t, NAMES) for t in texts]
    got = recogniser.spans(texts)
    hit = sum(s in k for g, k in zip(gold, got) for s in g)
    assert hit >= 0.97 * sum(map(len, gold)) and hit >= 0.97 * sum(map(len, got))


def test_what_is_found_is_the_networks(recogniser):
    """Spans come from the weights: with none learned nothing is found, and forms that the labels don't know are found all the same."""
    assert pii.Recogniser(pii._tagger(None)).tagger.p is not recogniser.tagger.p
    unseen = "Order 5 waits for 7 units. Mail tove.drayetti@corp now. Ask Alwena Brockquist, not the hotline."
    by_form = {unseen[a:b] for a, b, _ in candidates(unseen, NAMES)}
    by_network = {unseen[a:b] for a, b, _ in recogniser.spans([unseen])[0]}
    assert "Alwena Brockquist" in by_network and "Alwena Brockquist" not in by_form and by_network != by_form


def test_planted_texts_are_their_own_truth(recogniser):
    rows = planted.texts(50)
    assert all(t[a:b] and not t[a:b][0].isspace() for t, spans in rows for a, b, _ in spans)
    counts = planted.scores(rows, [s for _, s in rows])
    assert all(p == f == both > 0 for p, f, both in counts.values())


@pytest.mark.parametrize(
    "text, spans, want",
    [
        ("by Runa Drayetti.", [(4, 10, "person_name")], ["Runa Drayetti"]),
        ("by Runa Drayetti.", [(4, 12, "person_name")], ["Runa Drayetti"]),
        ("(404) 555 0134,", [(0, 15, "phone")], ["(404) 555 0134"]),
        ("Drayetti, B. left", [(0, 12, "person_name")], ["Drayetti, B."]),
        ("no 12", [(0, 5, "phone")], []),
        ("4 Kay Road", [(0, 4, "street_address"), (4, 10, "street_address")], ["4 Kay Road"]),
    ],
)
def test_tidy(text, spans, want):
    assert [text[a:b] for a, b, _ in pii.tidy(text, spans)] == want


def test_windows_are_joined(recogniser):
    one = "Ask Runa Drayetti, not the hotline."
    text = ("Order 5 waits. " * 40 + one) * 5 + "x" * 5000 + " " + one
    assert [text[a:b] for a, b, _ in recogniser.spans([text])[0]] == ["Runa Drayetti"] * 6


def test_tables(spark, recogniser):
    rows = [(1, "Ask Runa Drayetti, not the hotline.", ""), (1, "Ask Runa Drayetti, not the hotline.", ""), (2, None, ""), (3, "", ""), (4, "  ", ""), (5, "SSN 953-15-0301 was typed.", ""), (None, "Mail tove@corp.example now.", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, pii_type string")
    found = sorted(((r.doc_id, r.pii_type, r.pii_text) for r in pii.find(df, recogniser).collect()), key=repr)
    assert found == sorted([(1, "person_name", "Runa Drayetti")] * 2 + [(5, "id_number", "953-15-0301"), (None, "email", "tove@corp.example")], key=repr)
    red = {(r.doc_id, r.text) for r in pii.redact(df, recogniser).collect()}
    assert red == {(1, "Ask [PERSON_NAME], not the hotline."), (2, None), (3, ""), (4, "  "), (5, "SSN [ID_NUMBER] was typed."), (None, "Mail [EMAIL] now.")}
    assert pii.find(df.limit(0), recogniser).count() == 0


def test_fit_on_tables(spark, tmp_path):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(corpus(3, 60))], "doc_id long, text string")
    contacts = spark.createDataFrame([(1, *c, "x") for c in CONTACTS], "contact_id long, given_name string, family_name string, company string")
    keep = f"file://{tmp_path}/models"
    first = pii.fit_on(df, contacts, steps=3, rounds=2, keep=keep)
    again = pii.fit_on(df, contacts, steps=3, rounds=2, keep=keep)  # read, not trained
    other = pii.fit_on(df.limit(30), contacts, steps=3, rounds=2, keep=keep)
    assert len(list((tmp_path / "models").iterdir())) == 2 and any((first.tagger.p[k] != other.tagger.p[k]).any() for k in first.tagger.p)
    assert all((first.tagger.p[k] == again.tagger.p[k]).all() for k in first.tagger.p) and len(first.spans(["x", None])) == 2
    assert pii.find(df, pii.fit_on(df.limit(0), contacts.limit(0), steps=3)).columns[1:3] == ["pii_type", "pii_text"]


def test_contacts_only_label(spark, monkeypatch):
    """The bound on contacts limits labels alone: whoever stands beyond it is found by the network like anyone else, since finding asks no list."""
    monkeypatch.setattr(pii, "CONTACTS", 2)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(corpus(3, 60))], "doc_id long, text string")
    people = [("Ana", "Qwux"), ("Bo", "Zyth"), ("Cy", "Vrmp"), (None, "Hjeg"), ("Ed", None), ("Fay", "")]
    recogniser = pii.fit_on(df, spark.createDataFrame(people, "given_name string, family_name string"), steps=3, rounds=1)
    assert set(vars(recogniser)) == {"tagger"}


def test_long_texts_label_in_step_with_their_length():
    text = corpus(5, 1)[0] + " Ask Runa Drayetti, not the hotline. SSN 953-15-0301 was typed." * 3000
    assert len(candidates(text, NAMES)) >= 6000


def test_name_above_a_street_keeps_to_its_line():
    text = "--\nTove Drayetti\nKranichgasse 12\nRuna Brockbley\nObere Siebgasse 22d\n030/23125-062"
    assert [(k, text[a:b]) for a, b, k in candidates(text, NAMES)] == [("person_name", "Tove Drayetti"), ("street_address", "Kranichgasse 12"), ("person_name", "Runa Brockbley"), ("street_address", "Obere Siebgasse 22d"), ("phone", "030/23125-062")]
