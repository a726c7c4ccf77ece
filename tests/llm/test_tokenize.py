import base64
import random

import pytest

from marlgraph.llm import tokenize

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TEXTS = ["", "a", "  ", "it's we'll they've 'sound ''s 's", "a  b\n\n c\t", "\r\n x", "<|endoftext|>", "x'", "'", "日本語 12½ é é  　x", "\x1c\x1d a", "’s", "a" * 9000, "'" * 300, " " * 500 + "x", "\U0001f468‍\U0001f527 ok", "١٢٣ १२३"]


@pytest.fixture(scope="module")
def encoder():
    return tokenize.Encoder(tokenize.read_vocabulary())


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, tokenize.read_vocabulary().splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_the_public_tokenizer(encoder, reference):
    rnd = random.Random(1)
    alphabet = " \t\n\r '’srtvelmd12½é中\x1c!.-a\U0001f600́SLx_"
    texts = TEXTS + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 50))) for _ in range(4000)]
    ends, ids = encoder.encode(texts)
    for text, a, b in zip(texts, ends, ends[1:]):
        assert ids[a:b].tolist() == (reference.encode_ordinary(text) if text else []), repr(text)


def test_block_borders_do_not_show(encoder):
    import numpy as np

    text = "".join(TEXTS[1:12])
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    whole = tokenize.piece_starts(points, np.array([0]), 4096)
    for block in (1, 2, 3, 7, 64):
        assert (tokenize.piece_starts(points, np.array([0]), block) == whole).all()


def test_table_and_round_trip(spark):
    rows = [(i, t, "clash") for i, t in enumerate([None, *TEXTS])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = tokenize.encode(df, "doc_id", "text", offsets=True)
    by = {r.doc_id: r for r in got.collect()}
    assert len(by) == len(rows) and by[0].ids == [] and by[1].ids == []
    back = {r.doc_id: r.text for r in tokenize.decode(got, "doc_id").collect()}
    assert back == {i: t or "" for i, t, _ in rows}
    for i, t, _ in rows:
        assert all(0 <= o < len((t or "").encode()) for o in by[i].offsets) and list(by[i].offsets) == sorted(set(by[i].offsets))
    assert tokenize.encode(df.limit(0), "doc_id", "text").count() == 0
