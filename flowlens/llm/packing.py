"""Operator 6, packing: token windows by Karmarkar-Karp differencing.

1. One pass tokenises each document (its ids, then an end id), cuts it into
   pieces and gives each piece's checksum; only these small rows go on.  A
   document gives full windows first; what remains is cut at ``MAX_PIECE``.
2. Pieces are dealt to groups by a hash of (document, start, digest, place in
   the stored table), about ``GROUP_WINDOWS`` windows each, so a document of any
   length, any hot source and any row that is often repeated spread evenly.  A
   group is a bounded input of one ``applyInPandas`` call.
3. In a group, pieces of a whole window stand alone and the others are
   partitioned by multiway differencing into near-equal windows; the window
   count rises whenever a window exceeds the capacity.

Sequence ids are ``group * 2**20 + window``: unique, not dense.  Sequences
would be padded to ``capacity``; windows of a power of two need no padding.

Defined cases: a null text is an empty one (one piece with the end id);
repeated rows are packed as often as they occur; a null id is kept as null;
an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm import bpe
from flowlens.llm.common import map_columns, stored, tokenizer_path, whole_text
from flowlens.llm.differencing import pack
from flowlens.llm.tokens import BYTE_BPE

CAPACITY = 2048
#: Longest piece of what remains of a document after its full windows.
MAX_PIECE = 512
GROUP_WINDOWS = 256
END_ID = 1
#: Text bytes that are tokenised at a time.
SLICE = 2 << 20
_BITS = 20

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut(n: int, capacity: int, max_piece: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids."""
    full = n // capacity * capacity
    starts = [*range(0, full, capacity), *range(full, n, max_piece)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], n])]


def pieces(df: DataFrame, id_col: str, text_col: str, tokenizer: str,
           capacity: int, max_piece: int) -> DataFrame:
    def tokenise(rows):
        encode = bpe.encoder(tokenizer_path(tokenizer))
        end = np.array([END_ID], "<u4").tobytes()
        out = {"doc_id": [], "start": [], "length": [], "ids_crc32": [], "doc_tokens": []}
        for doc, text in zip(rows["doc_id"], rows["text"]):
            ids = memoryview(encode(text) + end)
            n = len(ids) // 4
            for start, length in cut(n, capacity, max_piece):
                out["doc_id"].append(doc)
                out["start"].append(start)
                out["length"].append(length)
                out["ids_crc32"].append(zlib.crc32(ids[4 * start:4 * (start + length)]))
                out["doc_tokens"].append(n)
        return out
    picked = df.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return map_columns(picked, tokenise, PIECES, SLICE)


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   tokenizer: str = BYTE_BPE, capacity: int = CAPACITY,
                   max_piece: int = MAX_PIECE, group_windows: int = GROUP_WINDOWS) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset``."""
    cut_up = stored(pieces(df, id_col, text_col, tokenizer, capacity, max_piece), "pieces")
    total = cut_up.agg(F.sum("length")).first()[0] or 0
    groups = max(1, math.ceil(total / (group_windows * capacity)))
    if group_windows * 8 >= 1 << _BITS:
        raise ValueError("group_windows is too large for the sequence ids")

    def pack_group(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "start", "ids_crc32"], kind="stable", ignore_index=True)
        length = pdf["length"].to_numpy()
        window = np.zeros(len(pdf), np.int64)
        part = length < capacity
        window[part] = pack(length[part], capacity)
        base = window[part].max() + 1 if part.any() else 0
        window[~part] = base + np.arange(int((~part).sum()))
        by = np.argsort(window, kind="stable")
        before = np.cumsum(length[by]) - length[by]
        first = np.r_[True, window[by][1:] != window[by][:-1]]
        offset = np.empty(len(pdf), np.int64)
        offset[by] = before - np.maximum.accumulate(np.where(first, before, 0))
        pdf["sequence_id"] = (int(key[0]) << _BITS) + window
        pdf["offset"] = offset
        return pdf.drop(columns="grp")
    grp = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups))
    return cut_up.withColumn("grp", grp).groupBy("grp") \
        .applyInPandas(pack_group, PIECES + ", sequence_id long, offset long")
