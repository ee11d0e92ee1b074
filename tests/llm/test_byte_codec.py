"""Operator 12 against the rank file's own library, and round trips."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from odd import documents, odd_documents, texts

from flowlens.llm import byte_codec as B

SPACES = " \n\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0       　​"


@pytest.fixture(scope="module")
def own():
    with open(public_tokenizers.path(B.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return B.codec(public_tokenizers.path(B.RANKS), public_tokenizers.PATTERN)


def split(flat, counts):
    out, at = [], 0
    for n in counts:
        out.append(list(flat[at:at + n]))
        at += n
    return out


def test_random_texts_of_all_white_space(own, codec):
    r = random.Random(7)
    some = [*SPACES, *SPACES, "a", "b1", "'s", "é", "日本", "🙂", ".", "٣", "don't", "word"]
    made = ["".join(r.choice(some) for _ in range(r.randint(0, 14))) for _ in range(15_000)]
    ids, counts, starts, ends = codec.encode(made, offsets=True)
    for text, got, a, b in zip(made, split(ids, counts), split(starts, counts), split(ends, counts)):
        assert got == own.encode_ordinary(text), text
        assert "".join(codec.token_texts(got)) == text
        assert all(codec.table[i] in text[x:y].encode() for i, x, y in zip(got, a, b)), text
    fast, fast_counts = codec.encode(made)
    assert fast.tolist() == ids.tolist() and fast_counts.tolist() == counts.tolist()


def test_every_code_point(own, codec):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    made = ["".join(f"a{chr(c)} {chr(c)}1" for c in points[at:at + 400]) for at in range(0, len(points), 400)]
    ids, counts = codec.encode(made)
    assert split(ids, counts) == [own.encode_ordinary(t) for t in made]


def test_round_trip_of_odd_rows(spark, own):
    got = {}
    for r in B.round_trip(odd_documents(spark)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, text in texts().items():
        ids = own.encode_ordinary(text or "")
        for r in got[i]:
            assert r["n_tokens"] == len(ids)
            assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert len(got[5]) == 2 and len(got[None]) == 2
    assert B.round_trip(documents(spark, [])).collect() == []


def test_offsets_and_split_characters(spark):
    df = documents(spark, [(1, "a 🙂 日本 don't"), (2, None)])
    rows = {r["doc_id"]: r for r in B.decode_tokens(B.encode(df, offsets=True)).collect()}
    text, r = "a 🙂 日本 don't", rows[1]
    assert "".join(r["pieces"]) == text and "" in r["pieces"]      # a character over several ids
    whole = [text[a:b] for a, b in zip(r["starts"], r["ends"])]
    assert [w for w, p in zip(whole, r["pieces"]) if w == p][0] == "a"
    assert (rows[2]["ids"], rows[2]["pieces"]) == ([], [])


def test_decoding_of_odd_ids(spark):
    df = spark.createDataFrame([(1, [64, None, 10**6, -3]), (2, None), (3, []), (4, [172])],
                               "doc_id long, ids array<int>")
    got = {r["doc_id"]: bytes(r["decoded"]) for r in B.decode(df).collect()}
    assert got[1].decode() == "a���" and got[2] == got[3] == b""
    parts = {r["doc_id"]: r["pieces"] for r in B.decode_tokens(df).collect()}
    assert parts[4] == ["�"]                                   # a lone byte never becomes a character
