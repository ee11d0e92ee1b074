"""Byte-pair tokenisation helpers shared by the token count and the packer.

``merge_count`` is the heap-and-linked-list merge loop: the pair of lowest
rank (leftmost on ties) is popped again and again, its two symbols become one
in the linked list, and the two new neighbours are pushed.  A stale heap entry
is recognised because the pair at its position no longer has its rank.

Texts are cut into pre-tokens first.  A text in which no white space touches
white space or an end of the text (``plain``) is cut by ``str.split``: before a
space, and on both sides of a newline, the byte-level pre-tokeniser then always
has a boundary, so a word can be looked up in a memo by itself.  Every other
text goes through the full pattern.  Both give the same pre-tokens; the memo
only saves work on words seen before and is bounded by ``MEMO_ENTRIES``.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from array import array

import numpy as np
import regex

#: Entries of a word memo; longer words are not kept.
MEMO_ENTRIES = 1_000_000
MEMO_WORD = 48

_SPACE = r"\p{White_Space}"
#: The byte-level pre-tokeniser's pattern (a fixed value), white space spelled out.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + _SPACE + r"\p{L}\p{N}]+|"
           + _SPACE + r"+(?!\P{White_Space})|" + _SPACE + "+")
pretokens = regex.compile(PATTERN).findall


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level
    vocabularies: printable Latin-1 bytes stand for themselves, the others
    get the code points from 256 on, in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        if b in own:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class Merges:
    """Vocabulary and merge ranks of a byte-level BPE ``.json`` file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.start = [vocab[c] for c in byte_symbols()]
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank[vocab[a] << 20 | vocab[b]] = r
            self.made.append(vocab[a + b])

    def merge_count(self, data: bytes) -> int:
        """Number of merges that byte-pair encoding makes in one pre-token."""
        n = len(data)
        if n < 2:
            return 0
        rank, made = self.rank, self.made
        sym = [self.start[b] for b in data]
        heap = []
        for i in range(n - 1):
            r = rank.get(sym[i] << 20 | sym[i + 1])
            if r is not None:
                heap.append(r << 40 | i)
        if not heap:
            return 0
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges, low = 0, (1 << 40) - 1
        while heap:
            top = heapq.heappop(heap)
            r, i = top >> 40, top & low
            j = after[i]
            if sym[i] < 0 or j >= n or rank.get(sym[i] << 20 | sym[j]) != r:
                continue  # one of the two symbols has been merged meanwhile
            merges += 1
            sym[i], sym[j] = made[r], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = rank.get(sym[i] << 20 | sym[k])
                if r is not None:
                    heapq.heappush(heap, r << 40 | i)
            h = before[i]
            if h >= 0:
                r = rank.get(sym[h] << 20 | sym[i])
                if r is not None:
                    heapq.heappush(heap, r << 40 | h)
        return merges

    def n_tokens(self, piece: str) -> int:
        """Tokens of one pre-token: its initial symbols minus the merges."""
        data = piece.encode("utf-8")
        return len(data) - self.merge_count(data)


class Memo(dict):
    """``word -> make(word)``, computed once per word.  Bounded by two
    generations of half the size: a full one becomes the old one, from which
    words still in use come back."""

    def __init__(self, make, entries: int | None = None):
        super().__init__()
        self.make, self.half, self.old = make, (entries or MEMO_ENTRIES) // 2, {}

    def __missing__(self, word):
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
        if len(word) <= MEMO_WORD:
            if len(self) >= self.half:
                self.old = dict(self)
                self.clear()
            self[word] = value
        return value


#: White space beside white space or at an end of the text.  The class also
#: holds U+001C to U+001F, which are no white space of the pre-tokeniser: such
#: texts only take the longer way.
_RUNS = re.compile(r"\s(?:\s|\Z)|\A\s").search


def plain(text: str) -> bool:
    """True when all white space stands alone between other characters (and
    the text is not empty)."""
    return text != "" and not _RUNS(text)


def words(text: str) -> list[str]:
    """Of a plain text: the pieces that start at each space (given without
    it) or newline (given with it); the first gets a newline in front."""
    return ("\n" + text).replace("\n", " \n").split(" ")[1:]


def unit(word: str) -> str:
    """The stretch of text that an item of :func:`words` stands for."""
    return word if word[0] == "\n" else " " + word


def segments(text: str, specials) -> list[str]:
    """Text between special strings; one special lies between two items."""
    out = [text]
    for s in specials:
        if s in text:
            out = [p for x in out for p in x.split(s)]
    return out


class Counter:
    """Token counts of whole texts."""

    def __init__(self, path: str):
        m = self.merges = Merges(path)
        self.piece = Memo(m.n_tokens, MEMO_ENTRIES // 2)
        piece = self.piece
        self.word = Memo(lambda w: sum([piece[p] for p in pretokens(unit(w))]))
        self.newline = m.n_tokens("\n")

    def plain_count(self, text: str) -> int:
        return sum(map(self.word.__getitem__, words(text))) - self.newline

    def __call__(self, text: str) -> int:
        parts = segments(text, self.merges.specials)
        n = len(parts) - 1
        for p in parts:
            if p:
                n += self.plain_count(p) if plain(p) else sum(map(self.piece.__getitem__, pretokens(p)))
        return n


#: Longest run of white space for the fast merge loop, whose pattern engine
#: has a bounded stack.
_LONG_RUN = re.compile(r"\s{5000}").search


class Encoder:
    """Token ids of whole texts, as little-endian unsigned 32-bit bytes: those
    of the ``tokenizers`` file at ``path``.

    The merges of that file run in ``tiktoken``'s loop.  It merges by the rank
    of the token that a pair makes, the file by the rank of the pair; both are
    the same, as each token has one pair that makes it.  Texts with a special
    string or a very long run of white space go through ``tokenizers`` whole.
    Nothing is kept between texts."""

    def __init__(self, path: str):
        import tiktoken
        self.path, self.tok = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, symbols = spec["model"]["vocab"], byte_symbols()
        byte_of = {c: b for b, c in enumerate(symbols)}
        made = [a + b for a, b in (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])]
        tokens = [*symbols, *made]
        if len(set(tokens)) < len(tokens):
            raise ValueError("a token of this vocabulary is made by two merges")
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.ids = np.array([vocab[t] for t in tokens], "<u4")
        self.fast = tiktoken.Encoding("merges", pat_str=PATTERN.replace(_SPACE, r"\s").replace(r"\P{White_Space}", r"\S"),
                                      mergeable_ranks={bytes([byte_of[c] for c in t]): r for r, t in enumerate(tokens)},
                                      special_tokens={})

    def library(self):
        """The file's own tokeniser, loaded where a text needs it."""
        if self.tok is None:
            from tokenizers import Tokenizer
            self.tok = Tokenizer.from_file(self.path)
        return self.tok

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.specials) or _LONG_RUN(text):
            return array("I", self.library().encode(text, add_special_tokens=False).ids).tobytes()
        return self.ids[self.fast.encode_ordinary(text)].tobytes() if text else b""


@functools.lru_cache(4)
def counter(path: str) -> Counter:
    return Counter(path)


@functools.lru_cache(4)
def encoder(path: str) -> Encoder:
    return Encoder(path)
