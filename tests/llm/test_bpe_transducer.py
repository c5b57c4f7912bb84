import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loamstack.llm import bpe_transducer as B

P = pytest.importorskip("public_tokenizers")


def naive(merges, text):
    """Apply the merges one rank at a time, from the left."""
    out = [bytes([b]) for b in text]
    for a, b in merges:
        i = 0
        while i < len(out) - 1:
            if out[i] == a and out[i + 1] == b:
                out[i : i + 2] = [a + b]
            i += 1
    return out


def random_table(rng, n):
    tokens, merges = [b"a", b"b", b"c"], []
    while len(merges) < n:
        pair = rng.choice(tokens), rng.choice(tokens)
        if pair not in merges and pair[0] + pair[1] not in tokens:
            merges.append(pair)
            tokens.append(pair[0] + pair[1])
    return B.MergeTable({t: i for i, t in enumerate(tokens)}, merges), merges


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 14), st.integers(0, 120), st.integers(1, 9))
def test_stream_equals_whole_for_any_merge_list(seed, n, size, window):
    rng = random.Random(seed)
    table, merges = random_table(rng, n)
    text = bytes(rng.choice(b"aab" if seed % 2 else b"abc") for _ in range(size))
    want = [table.tokens[t] for t in naive(merges, text)]
    assert table.encode_window(text) == want
    assert table._many([table.base[b] for b in text]) == want
    assert [i for part in table.encode_stream(text, window) for i in part] == want


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return B.Transducer(B.MergeTable.from_json(f.read())), Tokenizer.from_file(path)


def ids(machine, text):
    return np.frombuffer(b"".join(machine.encode(text)), "<u4").tolist()


ODD = ["", " ", "  a", "a  \n\n b", "<|endoftext|>", " <|endoftext|> x <|endoftext", "it's we'LL 'tis 12a3 ½", "x" * 5000, "ab " * 200000, " " * 3000 + "a", "日本語テスト 😀👍🏽 é", "\x00\x1c\x1f\x85  ", "a​b﻿", "ñ" * 2000]


@pytest.mark.parametrize("text", ODD, ids=range(len(ODD)))
def test_against_the_library(both, text):
    machine, library = both
    want = library.encode(text, add_special_tokens=False).ids
    assert ids(machine, text) == want
    assert "".join(machine.decode(machine.encode(text))) == library.decode(want, skip_special_tokens=False)


def test_blocks_do_not_matter(both, monkeypatch):
    machine, _ = both
    text = " ".join(random.Random(3).choice(["the", "naïve", "it's", "x" * 50, "\n\n", "12"]) for _ in range(3000))
    want = ids(machine, text)
    monkeypatch.setattr(B, "BLOCK", 37)
    assert ids(machine, text) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=6), max_size=8))
def test_bytes_to_text_in_any_pieces(parts):
    machine = B.ByteToText()
    assert "".join([*map(machine.feed, parts), machine.end()]) == b"".join(parts).decode("utf-8", "replace")


def test_documents(spark, both):
    _, library = both
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "null id"), (3, None), (3, "repeated id")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_tokens int")
    got = B.encode_documents(docs, P.path("byte_bpe_50k.json"), keep_ids=True).collect()
    assert len(got) == len(rows)
    for r, (i, t) in zip(got, rows):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert r.doc_id == i and r.n_tokens == len(want) and list(r.ids) == want and r.decoded == (t or "")
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert B.encode_documents(docs.limit(0), P.path("byte_bpe_50k.json")).count() == 0
