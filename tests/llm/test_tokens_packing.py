"""Operators 3 and 6 against the tokenizers library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
from odd import documents, odd_documents, texts
from tokenizers import Tokenizer

from flowlens.llm import bpe, packing, tokens
from flowlens.llm.differencing import difference, pack

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_counts_equal_the_library(spark, library):
    rows = tokens.count_tokens(odd_documents(spark)).collect()
    assert len(rows) == odd_documents(spark).count()
    t = texts()
    for r in rows:
        if r.doc_id is not None:
            n = len(ids(library, t[r.doc_id]))
            assert (r.n_tokens, r.n_bytes) == (n, len((t[r.doc_id] or "").encode())), r
            assert r.over_limit == (n > 512)


def test_whitespace_paths_agree(library):
    count, encode = bpe.counter(PATH), bpe.encoder(PATH)
    for text in ["a b", " a", "a ", "a  b", "a\nb", "a \nb", "a\n b", "\n", " ", "\x1cq", "a b", "a  b",
                 "it's we'LL", "ab\n\ncd", "x" * 3000, "1234 5", "é" * 50, "🙂🙂 x"]:
        want = ids(library, text)
        assert count(text) == len(want), repr(text)
        assert encode(text) == np.array(want, "<u4").tobytes(), repr(text)


def test_random_white_space(library):
    """Every character that is white space to Python or to the pre-tokeniser."""
    count, encode = bpe.counter(PATH), bpe.encoder(PATH)
    spaces = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000
              and (chr(c).isspace() or regex.match(r"\p{White_Space}", chr(c)))]
    assert "\xa0" in spaces and "\u3000" in spaces and "\x1c" in spaces
    r = random.Random(11)
    some = [*spaces, *" \n" * 12, *"aab1'.", "'s", "word", "\u200b", "\u65e5\u672c", "\u00e9", "<|endoftext|>"]
    made = ["price\xa010 ", "a\xa0b  c", "\u4e00\u3000\u4e8c ", "\xa0\u3000\xa0'LL"]
    made += ["".join(r.choice(some) for _ in range(r.randint(0, 12))) for _ in range(30_000)]
    for text in made:
        want = ids(library, text)
        assert count(text) == len(want), repr(text)
        assert encode(text) == np.array(want, "<u4").tobytes(), repr(text)


def test_long_runs(library):
    encode = bpe.encoder(PATH)
    for text in [" " * 200_000 + "x", "\n" * 100_000, "x" * 100_000, "1" * 100_000, ".!" * 50_000, "a " * 100_000]:
        assert encode(text) == np.array(ids(library, text), "<u4").tobytes()


def test_memo_stays_bounded():
    m = bpe.Memo(len, 10)
    for i in range(1000):
        assert m[str(i)] == len(str(i))
        assert len(m) <= 5 and len(m.old) <= 5
    assert m["x" * 1000] == 1000 and "x" * 1000 not in m


def test_empty_tables(spark):
    none = documents(spark, [])
    assert tokens.count_tokens(none).count() == 0
    assert packing.pack_documents(none).count() == 0


def test_pieces_cover_all_ids_and_windows_hold(spark, library):
    df = odd_documents(spark)
    rows = packing.pack_documents(df, max_piece=128, group_windows=4).collect()
    t = texts()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for doc, got in by_doc.items():
        if doc is None:
            continue
        want = np.array([*ids(library, t[doc]), 1], "<u4")
        copies = 2 if doc == 5 else 1
        at = sorted((r.start, r.length) for r in got)
        assert sum(n for _, n in at) == copies * len(want)
        for r in got:
            assert r.doc_tokens == len(want)
            assert r.ids_crc32 == zlib.crc32(want[r.start:r.start + r.length].tobytes())
        covered = sorted(x for s, n in at for x in range(s, s + n))
        assert covered == sorted(list(range(len(want))) * copies)
    for got in by_seq.values():
        at = 0
        for r in sorted(got, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.CAPACITY


def test_differencing_is_near_equal_and_window_count_rises():
    rng = np.random.default_rng(3)
    w = rng.integers(1, 513, 800)
    window = difference(w, 100)
    sums = np.bincount(window, weights=w, minlength=100)
    assert sums.sum() == w.sum() and sums.max() - sums.min() <= 30
    packed = pack(w, 2048)
    sums = np.bincount(packed, weights=w)
    assert sums.max() <= 2048 and len(sums) <= -(-w.sum() // 2048) + 2
    # 3 items of 1500 fit only one by one, although two windows would hold their sum
    assert len(set(pack(np.array([1500, 1500, 1000]), 2048).tolist())) == 3
    assert pack(np.array([], int), 2048).size == 0
    assert difference(np.array([5, 5, 5, 5]), 2).tolist().count(0) == 2


def test_padding_is_small(spark):
    rows = packing.pack_documents(documents(spark, [(i, f"word{i} " * (i % 97 + 3)) for i in range(3000)]))
    sums = [r["sum(length)"] for r in rows.groupBy("sequence_id").sum("length").collect()]
    assert sum(2048 - s for s in sums) / (2048 * len(sums)) < 0.03
