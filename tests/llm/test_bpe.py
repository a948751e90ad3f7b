import hashlib
import random

import numpy as np
import pytest

from siltstone.llm import bpe
from siltstone.llm.queries import tokenizer_file

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def pair():
    ranks, pattern = tokenizer_file()
    coder = bpe.PrefixCoder(bpe.read_ranks(ranks), pattern)
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(ranks), special_tokens={})
    return coder, other


def test_random_texts_encode_as_the_library_does(pair):
    coder, other = pair
    rng = random.Random(5)
    for _ in range(1500):
        text = "".join(rng.choice("aabbcd eéße\n\t  01漢🙂'sl the\xa0") for _ in range(rng.randint(0, 40)))
        want = other.encode_ordinary(text)
        chunks = coder.chunks(text)
        known = coder.remember(set(chunks))
        assert coder.encode(text) == want
        assert ",".join(known[c][0] for c in chunks) == ",".join(map(str, want))
        assert b"".join(known[c][2] for c in chunks) == text.encode()


def test_prefix_table_appends_exactly(pair):
    coder, other = pair
    rng = random.Random(6)
    for _ in range(300):
        piece = bytes(rng.choice(b"aabtheing ") for _ in range(rng.randint(1, 30)))
        table = coder.prefix_table(piece[: len(piece) // 2])
        assert coder.prefix_table(piece, table) == coder.prefix_table(piece)
        for end in range(1, len(piece) + 1):
            assert coder.walk(table[:end]) == other._encode_single_piece(piece[:end])


def test_edits_re_encode_as_from_scratch(pair):
    coder, other = pair
    rng = random.Random(7)
    text, edited = "", bpe.EditableText(coder)
    for _ in range(400):
        at = rng.randint(0, len(text))
        removed = rng.randint(0, min(5, len(text) - at))
        new = "".join(rng.choice("ab  \n'll1é,") for _ in range(rng.randint(0, 4)))
        text = text[:at] + new + text[at + removed :]
        edited.edit(at, removed, new)
        assert edited.text == text
        assert edited.encoding() == other.encode_ordinary(text)


def test_operator_on_odd_rows(spark, pair):
    _, other = pair
    ranks, pattern = tokenizer_file()
    rows = [(1, "Hello  world", 7), (None, None, 1), (2, "", 2), (3, "the thé " * 20_000, 3), (1, "Hello  world", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = bpe.encode_decode(df, ranks, pattern, with_ids=True).collect()
    assert len(got) == 5
    for row, (doc_id, text, old) in zip(got, rows, strict=True):
        want = other.encode_ordinary(text or "")
        assert (row.doc_id, row._n_tokens, row.n_tokens, row.ids) == (doc_id, old, len(want), want)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.encode_decode(df.limit(0), ranks, pattern).count() == 0


def test_another_pattern_is_followed(pair):
    ranks, spaced = tokenizer_file()
    assert spaced == bpe.SPACED
    pattern = r"(\p{L})+|\p{N}{1,2}| +|[^\p{L}\p{N} ]+"
    coder = bpe.PrefixCoder(bpe.read_ranks(ranks), pattern)
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(ranks), special_tokens={})
    for text in ("the  end of 12345 things", "a b", " lead", "trail ", "x\n\ny!? z", "été 99"):
        chunks = coder.chunks(text)
        known = coder.remember(set(chunks))
        assert ",".join(known[c][0] for c in chunks) == ",".join(map(str, other.encode_ordinary(text)))


def test_pairs_are_told_apart_side_by_side(pair, monkeypatch):
    coder, other = pair
    rng = random.Random(8)
    ids = sorted(coder.tokens)
    left, right = ([rng.choice(ids) for _ in range(20_000)] for _ in range(2))
    assert coder._apart_many(np.array(left), np.array(right)).tolist() == [coder._apart(a, b) for a, b in zip(left, right, strict=True)]
    fresh = bpe.PrefixCoder(coder.ranks, tokenizer_file()[1])
    monkeypatch.setattr(fresh, "_apart", None)  # not pair by pair
    words = {" " + "".join(rng.choice("aeinrstlokéß漢") for _ in range(rng.randint(1, 14))) for _ in range(2000)}
    known = fresh.ids_of(words)
    assert all(known[w] == ",".join(map(str, other.encode_ordinary(w))) for w in words)
