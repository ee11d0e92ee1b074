"""Operator 2, document fingerprints: Order MinHash in DataFrame functions.

A text's k-mers are its runs of ``K`` words (cut short at the end), each with
the number of its occurrence.  Words end at white space of any kind; of a text
whose words are longer than ``LONG_WORDS`` on average (one written without
spaces) the characters take the words' place.  A hash of (k-mer, occurrence) places it in one
of ``SKETCHES`` buckets; the ``PER_SKETCH`` smallest of a bucket, put back in
text order, are hashed as a tuple.  Tuples of two texts agree only where the
same k-mers are smallest and stand in the same order, so likeness falls with
moved words too, as edit distance does.

All of it is array functions inside one row: a packed (hash, position) long
is sorted twice, once to number occurrences and once to find the smallest of
each bucket, O(n log n) for n words.  ``let`` binds a value once.

Edited texts need the next document by id.  Documents are dealt to blocks of
about ``BLOCK`` consecutive documents (one shuffle of the texts); inside a block
the next one is ``lead``.  A grid of at most ``CELLS`` quantiles of the ids cuts
them into cells of equal numbers, and each cell into ranges of equal width, so
blocks follow documents and not ids: sparse, hashed or clustered ids and far
outliers change little.  The first document of each following block (found on
ids alone, by a window in each cell and one over the cells) is added to the
block before it as a last row that only ``lead`` sees.

Defined cases: a null text is an empty one; an empty text has a fingerprint
of its own; of documents that share an id the smaller text comes first; a
document without an id has no next one: the replaced half is left out and
``near_next`` is null; the only document is its own next one; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import whole_text

K = 2
SKETCHES_BITS = 6           # 64 sketches
PER_SKETCH = 2
POSITION_BITS = 26
LONG_WORDS = 40
BLOCK, CELLS = 1024, 128
BROADCAST_ROWS = 50_000
NULL_SALTS = 256


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _packed(h: Column, position: Column) -> Column:
    """The high bits of a hash, then the position."""
    return F.shiftleft(F.shiftright(h, POSITION_BITS), POSITION_BITS).bitwiseOR(position)


def _position(v: Column) -> Column:
    return v.bitwiseAND(F.lit((1 << POSITION_BITS) - 1).cast("long"))


def _starts(v: Column, bits: int) -> Column:
    """Places where the part of sorted longs above ``bits`` changes."""
    return F.filter(F.sequence(F.lit(0), F.size(v) - 1), lambda j: (j == 0) | (
        F.shiftright(F.get(v, j), bits) != F.shiftright(F.get(v, j - 1), bits)))


def fingerprint(text: Column) -> Column:
    """array<bigint>, one ``sketch * 2**32 + tuple hash`` per sketch in use."""
    position = lambda i: F.least(i, F.lit((1 << POSITION_BITS) - 1)).cast("long")

    def sorted_kmers(w):
        return F.sort_array(F.transform(w, lambda x, i: _packed(
            F.xxhash64(x, *[F.get(w, i + j) for j in range(1, K)]), position(i))))

    def numbered(s):
        return let(_starts(s, POSITION_BITS), lambda starts: F.sort_array(F.flatten(F.transform(
            starts, lambda at, r: F.transform(
                F.slice(s, at + 1, F.coalesce(F.get(starts, r + 1), F.size(s)) - at),
                lambda v, nth: _packed(F.xxhash64(F.shiftright(v, POSITION_BITS), nth), _position(v)))))))

    def tuples(t):
        return F.transform(_starts(t, 64 - SKETCHES_BITS), lambda j: let(F.get(t, j), lambda first: let(
            F.transform(
                # the smallest of this sketch, in text order
                F.sort_array(F.transform(
                    F.filter(F.slice(t, j + 1, PER_SKETCH), lambda v: F.shiftright(v, 64 - SKETCHES_BITS)
                             == F.shiftright(first, 64 - SKETCHES_BITS)),
                    lambda v: F.struct(_position(v).alias("p"), F.shiftright(v, POSITION_BITS).alias("h")))),
                lambda e: e["h"]),
            lambda chosen: F.shiftleft(F.shiftrightunsigned(first, 64 - SKETCHES_BITS), 32).bitwiseOR(
                F.shiftrightunsigned(F.xxhash64(chosen), 32)))))
    def pieces(t):
        return let(F.split(t, r"(?U)\s+"), lambda w: F.when(
            F.char_length(t) > LONG_WORDS * F.size(w), F.split(t, "")).otherwise(w))
    return let(pieces(text), lambda w: let(sorted_kmers(w), lambda s: let(numbered(s), tuples)))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal tuples among the sketches that either text uses."""
    used = F.size(F.array_union(F.transform(a, lambda v: F.shiftright(v, 32)),
                                F.transform(b, lambda v: F.shiftright(v, 32))))
    return F.size(F.array_intersect(a, b)) / used


def as_text(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda v: F.hex(v)), ".")


def block_of(ids: DataFrame):
    """``id -> block`` as a column function: cell * 2**32 + range in the cell.
    ``ids(id)`` has no nulls."""
    found = ids.agg(F.count(F.lit(1)).alias("n"),
                    F.percentile_approx("id", [i / CELLS for i in range(CELLS + 1)], 10_000).alias("q")).first()
    q = sorted(set(found["q"] or [0]))              # at most CELLS + 1 numbers
    starts, ends = q[:-1] or q, q[1:] or q
    share = max(1.0, found["n"] / len(starts) / BLOCK)   # blocks of a cell
    width = [max(1.0, (e - s) / share) for s, e in zip(starts, ends)]
    cells = F.array(*[F.lit(x).cast("long") for x in starts])
    widths = F.array(*[F.lit(float(w)) for w in width])

    def block(i: Column) -> Column:
        at = F.greatest(F.size(F.filter(cells, lambda x: x <= i)), F.lit(1))
        inside = (i - F.element_at(cells, at)).cast("double") / F.element_at(widths, at)
        # ids that the grid's accuracy leaves outside it join the nearest range
        return at.cast("long") * (1 << 32) + F.greatest(F.least(F.floor(inside), F.lit(int(2 * share) + 1)), F.lit(0))
    return block


def block_ends(ids: DataFrame, block) -> DataFrame:
    """``block, donor``: the first id after each block; for the last block
    the first id of all.  ``ids(id)`` has no nulls."""
    firsts = ids.groupBy(block(F.col("id")).alias("block")).agg(F.min("id").alias("first")) \
        .withColumn("cell", F.shiftright("block", 32))
    inner = firsts.withColumn("donor", F.lead("first").over(Window.partitionBy("cell").orderBy("block")))
    # at most CELLS rows
    cells = firsts.groupBy("cell").agg(F.min("first").alias("cfirst"))
    everything = Window.orderBy("cell")
    cells = cells.select("cell", F.lead("cfirst").over(everything).alias("after"),
                         F.first("cfirst").over(everything).alias("least"))
    return inner.join(cells, "cell").select("block", F.coalesce("donor", "after", "least").alias("donor"))


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, text, fp, next_text, next_fp`` of every document."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    known_ids = texts.where("id IS NOT NULL").select("id")
    block = block_of(known_ids)
    ends = block_ends(known_ids, block).checkpoint()
    donors = texts.join(F.broadcast(ends) if ends.count() <= BROADCAST_ROWS else ends,
                        F.col("id") == F.col("donor")) \
        .withColumn("nth", F.row_number().over(Window.partitionBy("block").orderBy("text"))).where("nth = 1") \
        .select("id", "text", "block", F.lit(0).alias("salt"), F.lit(True).alias("ghost"))
    own = texts.select("id", "text", block(F.col("id")).alias("block"),
                       F.when(F.col("id").isNull(), F.pmod(F.xxhash64("text"), F.lit(NULL_SALTS)).cast("int"))
                       .otherwise(0).alias("salt"), F.lit(False).alias("ghost"))
    dealt = own.unionByName(donors).repartition("block", "salt").withColumn("fp", fingerprint(F.col("text")))
    order = Window.partitionBy("block", "salt").orderBy("ghost", "id", "text")
    known = F.col("id").isNotNull()
    return dealt.select("id", "text", "fp", "ghost", F.when(known, F.lead("text").over(order)).alias("next_text"),
                        F.when(known, F.lead("fp").over(order)).alias("next_fp")) \
        .where("NOT ghost").drop("ghost")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next`` of every document."""
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", n - half), F.coalesce(F.left("next_text", half), F.lit("")))
    rows = with_next(docs, id_col, text_col).select(
        F.col("id").alias(id_col), n.cast("long").alias("n_chars"), "fp", "next_fp",
        let(edited, lambda e: F.struct(F.sha2(e.cast("binary"), 256).alias("sha"),
                                       fingerprint(e).alias("fp"))).alias("edited"))
    return rows.select(id_col, "n_chars", F.col("edited.sha").alias("edited_sha256"),
                       as_text(F.col("fp")).alias("fingerprint"),
                       as_text(F.col("edited.fp")).alias("edited_fingerprint"),
                       likeness(F.col("fp"), F.col("edited.fp")).alias("near_edited"),
                       likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
