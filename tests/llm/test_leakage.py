import random

from marlgraph.llm import leakage

WORDS = [f"w{i}" for i in range(300)]


def brute(docs, items, n=12):
    runs = {}
    for i, t in items:
        w = leakage.plain(t).split()
        for k in range(len(w) - n + 1):
            runs.setdefault(tuple(w[k : k + n]), set()).add(i)
    return sorted({(d, i) for d, t in docs for w in [leakage.plain(t).split()] for k in range(len(w) - n + 1) for i in runs.get(tuple(w[k : k + n]), ())}, key=repr)


def test_plain_form():
    assert leakage.plain("Straße, ＡＢＣ­​d  ½ ﬁ_x!") == " strasse abcd 1 2 fi x "
    assert leakage.plain(None) == leakage.plain(" .,") == ""
    assert leakage.plain("e‍́") == leakage.plain("É")


def test_equals_brute_force(spark):
    rnd = random.Random(4)
    items = [(i, " ".join(rnd.choice(WORDS[:40]) for _ in range(rnd.choice([5, 12, 13, 40])))) for i in range(30)]
    docs = []
    for d in range(500):
        own = [rnd.choice(WORDS[:40]) for _ in range(rnd.randrange(0, 80))]
        if d % 2:
            w = rnd.choice(items)[1].split()
            k = rnd.randrange(len(w))
            piece = w[k : k + rnd.choice([10, 11, 12, 13, 20])]
            at = rnd.randrange(len(own) + 1)
            own[at:at] = [rnd.choice([str.upper, str.lower])(x) for x in piece]
        docs.append((d, rnd.choice([" ", ", ", "\n", " ­ "]).join(own)))
    docs += [(1000, None), (1001, ""), (1002, items[3][1] * 2 + " " + "x " * 30_000 + items[2][1]), (None, items[3][1])]
    docs += docs[:5]
    df = spark.createDataFrame([(*r, "clash") for r in docs], "doc_id long, text string, item_id string")
    it = spark.createDataFrame([*items, (99, None), (98, ""), (97, items[3][1])], "item_id long, text string")
    want = brute(docs, [*items, (97, items[3][1])])
    assert sorted(map(tuple, leakage.leaks(df, it).collect()), key=repr) == want and len(want) > 20
    assert leakage.leaks(df.limit(0), it).count() == 0 and leakage.leaks(df, it.limit(0)).count() == 0


def test_blocks_of_items_make_more_passes(spark, monkeypatch):
    items = [(i, " ".join(f"a{i}b{j}" for j in range(14))) for i in range(20)]
    monkeypatch.setattr(leakage, "BLOCK", 300)
    df = spark.createDataFrame([(i, "pre " + t) for i, t in items], "doc_id long, text string")
    got = leakage.leaks(df, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect())) == [(i, i) for i in range(20)]


def test_edits_within_the_budget():
    passage = " ".join(f"word{i}" for i in range(12))
    p = leakage.Passages([1], [leakage.plain(passage)], 12, 3)

    def found(text):
        import numpy as np

        codes = leakage.codes_of(leakage.plain(text))
        doc, item, diagonal, places = p.regions(codes, np.zeros(len(codes), int))
        return bool(p.aligned(codes, doc * 0, doc * 0 + len(codes), item, diagonal, places).any())

    assert found("before " + passage + " after")
    assert found("zz " + passage.replace("word3", "wrd3").replace("word9", "wordd9") + " yy")
    assert found(passage.replace("word5", "wurm5").replace("word0", "vord0"))
    assert not found(passage.replace("word5", "other words").replace("word8", "nothing"))
    assert not found("word1 word2 word3")


def distance_to_piece(passage, text):
    """Least edits between the passage and any piece of the text."""
    cost = [0] * (len(text) + 1)
    for i, c in enumerate(passage):
        step = [i + 1]
        for j, t in enumerate(text):
            step.append(min(cost[j] + (c != t), cost[j + 1] + 1, step[j] + 1))
        cost = step
    return min(cost)


def test_edits_equal_brute_force(spark, monkeypatch):
    """Planted passages with none to six edits of characters, against an alignment of every passage with every document."""
    monkeypatch.setattr(leakage, "PAIRS", 50)
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 6)))
    items = [(i, " ".join(word() for _ in range(rnd.choice([6, 8])))) for i in range(4)] + [(4, "")]
    docs = []
    for d in range(40):
        own = " ".join(word() for _ in range(rnd.randrange(0, 10)))
        piece = list(rnd.choice(items[:4])[1])
        for _ in range(d % 7):
            k = rnd.randrange(len(piece))
            rnd.choice([lambda k=k: piece.insert(k, "z"), lambda k=k: piece.pop(k), lambda k=k: piece.__setitem__(k, "y")])()
        docs.append((d, own + " " + "".join(piece) + " " + own))
    docs += [(100, None), (101, ""), docs[3]]
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for errors in (0, 1, 2):
        want = set()
        for d, t in docs:
            for i, text in items:
                blanks = [k for k, c in enumerate(leakage.plain(text)) if c == " "]
                passages = [leakage.plain(text)[a : b + 1] for a, b in zip(blanks, blanks[6:])]
                if any(distance_to_piece(p, leakage.plain(t)) <= errors for p in passages):
                    want.add((d, i))
        assert set(map(tuple, leakage.leaks(df, it, words=6, errors=errors).collect())) == want and want


def test_an_index_is_built_once_per_worker():
    value = ([1], [leakage.plain(" ".join(f"word{i}" for i in range(12)))])
    one = leakage.built(7, value, 12, 0)
    assert leakage.built(7, value, 12, 0) is one and leakage.built(8, value, 12, 0) is not one and leakage.built(9, value, 12, 0).q == one.q and len(leakage._BUILT) == 2
