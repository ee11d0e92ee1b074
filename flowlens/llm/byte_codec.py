"""Operator 12, byte-level BPE encoding and decoding over Arrow batches.

Encoding.  ``codec`` builds a ``tokenizers`` BPE model from a file of ranks:
each token of more than one byte is the merge of the two parts that
byte-pair merging leaves of it just below its own rank.  The byte-to-character
table turns bytes into the printable characters that the model works on; a
pre-token that is a token itself is taken whole, as the rank files ask for.

Per slice of an Arrow batch the texts are cut into units, the units are
dictionary-encoded, the library encodes each distinct unit once, with its
character offsets, and numpy gathers ids and offsets back into one Arrow list
per text.  Where no white space touches white space or the ends of a text, a
unit starts at each ' ' and at each newline: the pattern has a boundary
there whatever stands on either side.  Every other text is one unit, cut by
the library's own pattern.  Nothing is kept between slices, so a worker's
memory is bounded by ``SLICE_BYTES`` of text and its ids.

Offsets are code points of the text, end exclusive.  Tokens that hold parts
of one character all carry the offsets of that whole character.

Decoding reverses the byte table: the bytes of each id are gathered by numpy.
``decode_tokens`` gives a text per token; a character whose bytes are split
over tokens comes out whole with the token that completes it, and bytes that
never become a character are U+FFFD, as in a streaming decoder.

Defined cases: a null text is an empty one (no ids); null ids decode to
nothing, and a null or unknown id inside a list to U+FFFD; repeated rows give
repeated results; rows keep their id, null included; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import codecs
import functools
import os
import re
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from flowlens.llm.bpe import byte_symbols
from flowlens.llm.common import bounded_batches, slices, tokenizer_path, whole_text

RANKS = "byte_bpe_50k.tiktoken"
SLICE_BYTES = 8 << 20
#: Units that the library encodes at a time.
CALL_UNITS = 8192
#: White space beside white space or at an end of the text.
_RUNS = re.compile(r"\s(?:\s|\Z)|\A\s").search


def halves(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts whose merge makes ``token``: byte-pair merging of its
    bytes with the ranks below its own, until two are left."""
    limit = ranks[token]
    parts = [token[i:i + 1] for i in range(len(token))]
    while len(parts) > 2:
        found = [(ranks.get(a + b, limit), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
        rank, i = min(found)
        if rank >= limit:
            return None
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return parts[0], parts[1]


def gather(values: np.ndarray, offsets: np.ndarray, which: np.ndarray):
    """The stretches ``which`` of a flat array, joined, and their lengths."""
    lengths = offsets[which + 1] - offsets[which]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total) + np.repeat(offsets[which] - (ends - lengths), lengths)
    return values[at], lengths


def _offsets(lengths) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype(np.int64)


class Codec:
    """Encoder and decoder for one file of ranks."""

    def __init__(self, path: str, pattern: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        symbols = byte_symbols()
        shown = {token: "".join([symbols[b] for b in token]) for token in ranks}
        merges = []
        for token in sorted(ranks, key=ranks.get):
            if len(token) > 1 and (pair := halves(token, ranks)):
                merges.append((shown[pair[0]], shown[pair[1]]))
        tok = self.tok = Tokenizer(models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges,
                                              ignore_merges=True))
        tok.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(Regex(pattern), "isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        # decoding: the characters of each token back to bytes; one entry more
        # for ids that are no token
        byte_of = {c: b for b, c in enumerate(symbols)}
        top = max(ranks.values()) + 1
        table = ["�".encode()] * (top + 1)
        for i in ranks.values():
            table[i] = bytes([byte_of[c] for c in tok.id_to_token(i)])
        self.table, self.unknown = table, top
        self.bytes = np.frombuffer(b"".join(table), np.uint8)
        self.offsets = _offsets([len(t) for t in table])

    @staticmethod
    def units(text: str) -> list[str]:
        """Keys of the units of a text.  A key is a unit without its space,
        one that starts with a newline, or a space and the first unit."""
        if not text:
            return []
        if _RUNS(text):
            return [" " + text]
        out = text.replace("\n", " \n").split(" ")
        out[0] = " " + out[0]
        return out

    @staticmethod
    def unit(key: str) -> str:
        return key[1:] if key[0] == " " else key if key[0] == "\n" else " " + key

    def encode(self, texts: list[str], offsets: bool = False):
        """Flat ids and the number of ids per text; with ``offsets`` also flat
        start and end code points."""
        number: defaultdict[str, int] = defaultdict()
        number.default_factory = number.__len__
        found, counts = array("i"), []
        for text in texts:
            keys = self.units(text)
            found.extend(map(number.__getitem__, keys))
            counts.append(len(keys))
        which = np.frombuffer(found, np.int32) if found else np.zeros(0, np.int32)
        distinct = [self.unit(k) for k in number]
        call = self.tok.encode_batch if offsets else self.tok.encode_batch_fast
        flat, sizes, spans = array("i"), [], []
        for at in range(0, len(distinct), CALL_UNITS):
            for e in call(distinct[at:at + CALL_UNITS], add_special_tokens=False):
                of_e = e.ids
                flat.extend(of_e)
                sizes.append(len(of_e))
                if offsets:
                    spans += e.offsets
        of_unit = _offsets(sizes)
        ids, lengths = gather(np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32), of_unit, which)
        per_text = np.add.reduceat(np.r_[lengths, 0], _offsets(counts)[:-1]) if texts else np.zeros(0, np.int64)
        per_text = np.where(np.array(counts, np.int64) > 0, per_text, 0)
        if not offsets:
            return ids, per_text
        spans = np.array(spans, np.int64).reshape(-1, 2)
        chars = np.array([len(u) for u in distinct], np.int64)[which] if len(which) else np.zeros(0, np.int64)
        before = np.cumsum(chars) - chars            # code points before a unit, over all texts
        first = _offsets(counts)[:-1]
        start = before[np.minimum(first, max(len(which) - 1, 0))] if len(which) else np.zeros(len(counts), np.int64)
        base = np.repeat(before - np.repeat(start, counts), lengths)
        return ids, per_text, base + gather(spans[:, 0], of_unit, which)[0], base + gather(spans[:, 1], of_unit, which)[0]

    def _known(self, ids: np.ndarray) -> np.ndarray:
        return np.where((ids >= 0) & (ids < self.unknown), ids, self.unknown)

    def decode(self, ids: np.ndarray):
        """Flat bytes of flat ids, and the number of bytes per id."""
        return gather(self.bytes, self.offsets, self._known(np.asarray(ids, np.int64)))

    def token_texts(self, ids) -> list[str]:
        """The text that each id adds.  Their concatenation is the decoded
        text: a split character belongs to the token that completes it."""
        step = codecs.getincrementaldecoder("utf-8")("replace")
        known = self._known(np.asarray(ids, np.int64)).tolist()
        return [step.decode(self.table[i], final=n == len(known)) for n, i in enumerate(known, 1)]


@functools.lru_cache(4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def default_pattern() -> str:
    import public_tokenizers
    return public_tokenizers.PATTERN


def _map(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` of ``fn(slice) -> list of arrays``."""
    ddl = StructType.fromDDL(schema)
    bounded_batches(df.sparkSession)

    def run(batches):
        out = to_arrow_schema(ddl)
        for batch in batches:
            for part in slices(batch, SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(fn(part), out)], schema=out)
    return df.mapInArrow(run, ddl)


def _lists(values, lengths) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(_offsets(lengths).astype(np.int32)), pa.array(values))


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS,
           pattern: str | None = None, offsets: bool = False) -> DataFrame:
    """``id_col, ids`` for each row, with ``offsets`` also ``starts`` and
    ``ends`` (code points of the text)."""
    pattern = pattern or default_pattern()

    def run(part: pa.RecordBatch):
        found = codec(tokenizer_path(ranks), pattern).encode(part.column(1).to_pylist(), offsets)
        return [part.column(0), *[_lists(x, found[1]) for x in (found[0], *found[2:])]]
    picked = df.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    more = ", starts array<int>, ends array<int>" if offsets else ""
    return _map(picked, run, "id long, ids array<int>" + more).withColumnRenamed("id", id_col)


def _flat(column: pa.Array):
    """Ids of a list column as one array (nulls as -1) and a count per row."""
    counts = np.array(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    values = column.flatten()
    return values.fill_null(-1).to_numpy(zero_copy_only=False), counts


def decode(df: DataFrame, ids_col: str = "ids", into: str = "decoded", ranks: str = RANKS) -> DataFrame:
    """All columns of ``df`` and ``into``: the bytes (binary) of its ids."""
    return _decoded(df, ids_col, into, "binary", ranks)


def decode_tokens(df: DataFrame, ids_col: str = "ids", into: str = "pieces", ranks: str = RANKS) -> DataFrame:
    """All columns of ``df`` and ``into``: one string per id (``array``)."""
    return _decoded(df, ids_col, into, "array<string>", ranks)


def _decoded(df: DataFrame, ids_col: str, into: str, kind: str, ranks: str) -> DataFrame:
    at, pattern = df.columns.index(ids_col), default_pattern()

    def run(part: pa.RecordBatch):
        c = codec(tokenizer_path(ranks), pattern)
        ids, counts = _flat(part.column(at))
        if kind == "binary":
            data, lengths = c.decode(ids)
            ends = _offsets(lengths)[_offsets(counts)]
            made = pa.Array.from_buffers(pa.large_binary(), len(counts),
                                         [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])
        else:
            rows = np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else []
            made = pa.array([c.token_texts(x) for x in rows], pa.list_(pa.string()))
        return [*part.columns, made]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != into)
    return _map(df.drop(into), run, f"{fields}, `{into}` {kind}")


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS) -> DataFrame:
    """``id_col, n_tokens, ids_sha256, decoded_sha256``: the ids of each text
    and the bytes decoded from them, as digests."""
    coded = decode(encode(df, id_col, text_col, ranks), ranks=ranks)
    return coded.select(
        id_col, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
