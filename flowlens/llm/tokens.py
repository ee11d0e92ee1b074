"""Operator 3, token counts: byte-pair merging with a heap and a linked list.

``count_tokens`` gives the tokens of whole texts without making any ids: per
pre-token, initial symbols minus merges (``bpe.Merges.merge_count``).  It is a
map over rows (no shuffle); memory is one slice of texts and a bounded memo
of words per Python worker.

Defined cases: a null text is an empty one (0 bytes, 0 tokens); a special
string of the vocabulary inside a text is one token; very long words cost
O(n log n) in their length; repeated rows give repeated results; an empty
table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm import bpe
from flowlens.llm.common import map_columns, tokenizer_path, whole_text

LIMIT = 512
BYTE_BPE = "byte_bpe_50k.json"


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 tokenizer: str = BYTE_BPE, limit: int = LIMIT) -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` for each row."""
    def count(rows):
        n_tokens = bpe.counter(tokenizer_path(tokenizer))
        counts = [n_tokens(t) for t in rows["text"]]
        return {"id": rows["id"], "n_bytes": rows["n_bytes"], "n_tokens": counts,
                "over_limit": [n > limit for n in counts]}
    text = whole_text(text_col)
    picked = df.select(F.col(id_col).cast("long").alias("id"), text.alias("text"),
                       F.octet_length(text).cast("long").alias("n_bytes"))
    return map_columns(picked, count, "id long, n_bytes long, n_tokens long, over_limit boolean") \
        .withColumnRenamed("id", id_col)
