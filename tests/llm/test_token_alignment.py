import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loamstack.llm import token_alignment as T
from loamstack.llm.bpe_transducer import byte_alphabet

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  ", "a", " a  b ", "Hello wörld\n\nx 😀 <s> a", "<|endoftext|> <unk></s>", "\nfoo\n", "a\tb c\t d\r\n e", "▁", "a▁b", "日本語 テキスト", "👩‍👩‍👧 ok", "\x00a　b", "x" * 70_000, "é   ß\x85 z", "don't we're", "a" * 3 + " " * 40 + "b" + "\n" * 30, "​́ é", "\x1c \x1d\n\x1e"]


@pytest.fixture(scope="module")
def both():
    with open(A_PATH, encoding="utf-8") as a, open(B_PATH, "rb") as b:
        return T.Aligner(a.read(), b.read())


def whole(both, text):
    """Tokens of the whole text by the libraries alone: ids and bytes of A and B, or None."""
    if not text:
        return None
    alphabet, raw = byte_alphabet(), (" " + text).encode()
    a = both.a.encode(" " + text, add_special_tokens=False).ids
    b = both.b.encode(text)
    a_bytes = [bytes(alphabet[c] for c in both.a.id_to_token(i)) for i in a]
    names = [both.b.id_to_piece(i) for i in b]
    b_bytes = [bytes([int(x[3:5], 16)]) if both.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in zip(b, names, strict=True)]
    return (a, a_bytes, b, b_bytes) if b"".join(a_bytes) == raw == b"".join(b_bytes) else None


def slow(both, text):
    found = whole(both, text)
    if found is None:
        return None
    a, a_bytes, b, b_bytes = found

    def spans(pieces):
        out, at = [], 0
        for x in pieces:
            out.append((at, at + len(x)))
            at += len(x)
        return out

    sa, sb = spans(a_bytes), spans(b_bytes)
    cuts = sorted({e for _, e in sa} & {e for _, e in sb})
    where = {cut: k for k, cut in enumerate(cuts)}
    groups = defaultdict(lambda: ([], []))
    for side, ids, sp in ((0, a, sa), (1, b, sb)):
        for i, (_, e) in zip(ids, sp, strict=True):
            groups[next(where[c] for c in cuts[max(0, _first(cuts, e)) :])][side].append(i)
    links, j = [], 0
    for i, (s, e) in zip(a, sa, strict=True):
        while j and sb[j - 1][1] > s:
            j -= 1
        while j < len(sb) and sb[j][0] < e:
            if sb[j][1] > s:
                links.append((i, b[j]))
            j += 1
    text_of = ";".join(",".join(map(str, groups[k][0])) + "|" + ",".join(map(str, groups[k][1])) for k in sorted(groups))
    return len(a), len(b), len(groups), links, hashlib.sha256(text_of.encode()).hexdigest()


def _first(cuts, e):
    import bisect

    return bisect.bisect_left(cuts, e)


def check(both, text):
    (na, nb, ng, nl), digest, codes, times = both.document(text or "")
    want = slow(both, text)
    if want is None:
        assert (na, nb, ng, nl, digest, len(codes)) == (0, 0, 0, 0, "", 0)
        return
    assert (na, nb, ng, nl, digest) == (*want[:3], len(want[3]), want[4])
    assert dict(zip(codes.tolist(), times.tolist(), strict=True)) == Counter(x * both.size + y for x, y in want[3])


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(both, text):
    check(both, text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r\x0b  abcé😀'▁<>|1.{;"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_chunks_against_whole_texts(both, text):
    check(both, text)


def test_small_blocks_and_memo(both, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 3)
    monkeypatch.setattr(T, "MEMO_CHUNKS", 5)
    for text in ["the quick brown fox the quick\nbrown fox jumps", *ODD[5:13]]:
        check(both, text)


def test_frequent_chunks_outlive_a_full_memo(both, monkeypatch):
    monkeypatch.setattr(T, "MEMO_CHUNKS", 60)
    both.clear()
    learnt, learn = [], both.learn
    monkeypatch.setattr(both, "learn", lambda new: (learnt.extend(new), learn(new))[1])
    texts = [f"the same words come again and {' '.join(f'rare{i}x{k}' for k in range(8))}" for i in range(40)]
    got = [both.document(t) for t in texts]
    assert learnt.count(" same") == 1 and len(both.groups) <= 60 + 16 and len(both.place) == len(both.groups)
    both.clear()
    for t, (facts, digest, codes, times) in zip(texts, got, strict=True):
        both.clear()
        again = both.document(t)
        assert again[:2] == (facts, digest) and again[2].tolist() == codes.tolist() and again[3].tolist() == times.tolist()
    both.clear()


@pytest.mark.parametrize("frequent", [T.BROADCAST_PAIRS, 3, 0])
def test_counts_of_the_corpus(spark, both, frequent):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "the fox"), (3, "the fox the fox"), (3, "the fox the fox"), *((100 + i, f"word {i % 7} the fox {'ab' * (i % 5)}") for i in range(40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS codes", "3 AS n", "4 AS times", "5 AS `a.b`")
    want, counts = [slow(both, t) for _, t in rows], Counter()
    for w in want:
        counts.update(w[3] if w else [])
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    full = [(i, 0, 0, 0, 0, 0, 0, "") if w is None else (i, *w[:3], len(w[3]), sum(counts[p] == best[p[1]] for p in w[3]), sum(counts[p] for p in w[3]), w[4]) for (i, _), w in zip(rows, want, strict=True)]
    got = T.alignment(docs, A_PATH, B_PATH, frequent).collect()
    assert sorted(map(tuple, got), key=str) == sorted(full, key=str)


def test_empty_table(spark):
    assert T.alignment(spark.createDataFrame([], "doc_id long, text string"), A_PATH, B_PATH).count() == 0
