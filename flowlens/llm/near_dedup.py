"""Operator 7, near-duplicates: SetSketch registers, banded, then verified.

1. One pass over the texts makes each document's set size, set digest,
   registers and band keys (``setsketch``); texts of equal sets form a class
   (pre-aggregated), whose smallest id stands for it from here on.
2. Band keys are counted (pre-aggregated); only keys of several classes go
   on.  A key's classes are compared with one of them, its centre: the number
   of pairs is linear in the number of rows.
3. Pairs get a joint maximum-likelihood estimate from their registers; those
   that may reach the limit are confirmed on the full sets.
4. Confirmed links give components (``graph``).  What a key leaves undecided
   are pairs of different components.  Keys of at most
   ``SMALL`` classes compare these pairs (a linear bound).  Larger ones are
   joined to clusters of ``BLOCK`` members a block, and pairs of blocks of
   different components are compared on the full sets by a matrix product in
   one task each (``COLUMNS`` shingles at a time), which gives only the links.
   A group whose members are all linked needs none of this; so no pair that
   shares a key stays undecided.

At likeness 0.8, 40 bands of 5 registers miss a pair with a probability of
about 1e-7.  Joins on hot keys are ordinary sort-merge joins that adaptive
execution splits.  Intermediate tables lie in the shared checkpoint folder.

Defined cases: a null or blank text has no shingles and is linked with
nothing (component: itself); a null id has a null component and is kept; of
rows that share an id each gets the component of its own text (a class is
known by the digest of its set, not by an id); an empty table an empty result; other columns are not read (``keep_one`` keeps them
and leaves one row of each kept id).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from flowlens.llm import setsketch as ss
from flowlens.llm.common import bounded_batches, slices, stored, whole_text
from flowlens.llm.graph import components

PERCENT = 80
SLICE = 2 << 20
SMALL, BLOCK = 32, 512
#: Shingles of a block pair that one product compares.
COLUMNS = 1 << 14
BROADCAST_ROWS = 200_000

SKETCH = "id long, n long, digest binary, bands array<long>"


def set_digest(members: np.ndarray) -> bytes:
    return hashlib.blake2b(members.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    ddl = StructType.fromDDL(SKETCH)

    def run(batches):
        schema = to_arrow_schema(ddl)
        for batch in batches:
            for part in slices(batch, SLICE):
                sets = ss.shingle_sets(part.column("text").to_pylist())
                keys = ss.bands(ss.registers(sets))
                n = pa.array([len(s) for s in sets], pa.int64())
                digest = [set_digest(s) for s in sets]
                per = keys.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * per),
                                                 pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column("id"), n, pa.array(digest, pa.binary()), lists],
                                                 schema=schema)
    return docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text")) \
        .mapInArrow(run, ddl)


def set_table(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, members`` (sorted hashes as bytes) and ``regs`` (registers, then
    the set's size) of the ``classes`` (id, rep, digest), from the texts of
    their smallest documents."""
    ids = classes.select(F.col("rep").alias("doc")).distinct()
    few = ids.count() <= BROADCAST_ROWS
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), whole_text(text_col).alias("text")) \
        .join(F.broadcast(ids) if few else ids, "doc", "left_semi").select("text")
    ddl = StructType.fromDDL("digest binary, members binary, regs binary")

    def run(batches):
        schema = to_arrow_schema(ddl)
        for batch in batches:
            for part in slices(batch, SLICE):
                sets = ss.shingle_sets(part.column("text").to_pylist())
                regs = ss.registers(sets)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([set_digest(s) for s in sets], pa.binary()),
                     pa.array([s.tobytes() for s in sets], pa.binary()),
                     pa.array([r.tobytes() + len(s).to_bytes(4, "little") for r, s in zip(regs, sets)], pa.binary())],
                    schema=schema)
    return texts.mapInArrow(run, ddl).dropDuplicates(["digest"]) \
        .join(classes.select("id", "digest"), "digest").drop("digest")


def _pair_columns(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """``a, b`` with the column of either document as ``u`` and ``v``."""
    left = table.select(F.col("id").alias("a"), F.col(column).alias("u"))
    right = table.select(F.col("id").alias("b"), F.col(column).alias("v"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "u", "v")


def _filtered(pairs: DataFrame, keep) -> DataFrame:
    """The pairs for which ``keep(lists u, v)`` holds."""
    ddl = StructType.fromDDL("a long, b long")

    def run(batches):
        schema = to_arrow_schema(ddl)
        for batch in batches:
            for part in slices(batch):
                good = keep(part.column("u").to_pylist(), part.column("v").to_pylist())
                yield part.select(["a", "b"]).filter(pa.array(good)).cast(schema)
    return pairs.mapInArrow(run, ddl)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b`` of the pairs that reach ``percent``: first those that may by
    the registers' likelihood, then by the full sets."""
    def likely(u, v):
        ku, kv = (np.stack([np.frombuffer(x, np.uint16) for x in s]) for s in (u, v))
        sizes = [k[:, -2:].copy().view(np.uint32)[:, 0].astype(np.int64) for k in (ku, kv)]
        return ss.may_reach(percent / 100, ku[:, :-2], kv[:, :-2], *sizes)[1]

    def exact(u, v):
        keep = np.zeros(len(u), bool)
        for i, (x, y) in enumerate(zip(u, v)):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
        return keep
    near = stored(_filtered(_pair_columns(pairs, sets, "regs"), likely), "near")
    return _filtered(_pair_columns(near, sets, "members"), exact)


def block_links(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components inside clusters: ``placed`` has
    ``id, component, cluster``.  Large components have blocks of their own, and
    no block is compared with one of the same component."""
    size = placed.groupBy("cluster", "component").agg(F.count("*").alias("n"))
    own = F.when(F.col("n") >= BLOCK // 2, F.col("component"))
    sized = placed.join(size, ["cluster", "component"]).withColumn("own", own)
    total = sized.groupBy("cluster", "own").agg(F.count("*").alias("m")).toDF("_c", "_o", "m")
    sized = sized.join(total, (F.col("cluster") == F.col("_c")) & F.col("own").eqNullSafe(F.col("_o")))
    block = F.concat_ws("/", F.coalesce(F.col("own").cast("string"), F.lit("")),
                        F.pmod(F.xxhash64("id"), F.ceil(F.col("m") / BLOCK)).cast("string"))
    rows = stored(sized.select("id", "component", "cluster", "own", block.alias("block")), "blocks")
    blocks = rows.select("cluster", "own", "block").distinct()
    other = blocks.toDF("cluster", "own2", "block2")
    pairs = blocks.join(other, "cluster").where("block <= block2 AND (own IS NULL OR own2 IS NULL OR own <> own2)") \
        .select("cluster", "block", "block2")
    first = rows.join(pairs, ["cluster", "block"]).select("id", "component", "cluster", "block", "block2",
                                                          F.lit(0).alias("side"))
    second = rows.withColumnRenamed("block", "block2").join(pairs.where("block <> block2"), ["cluster", "block2"]) \
        .select("id", "component", "cluster", "block", "block2", F.lit(1).alias("side"))
    full = first.unionAll(second).join(sets.select("id", "members"), "id")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable", ignore_index=True)
        members = [np.frombuffer(m, np.uint64) for m in pdf["members"]]
        n = np.array([len(m) for m in members])
        words, at = np.unique(np.concatenate(members), return_inverse=True)
        row = np.repeat(np.arange(len(n)), n)
        often = np.bincount(at) > 1  # a shingle of one member is in no intersection
        place = np.cumsum(often) - 1
        use = np.flatnonzero(often[at])
        use = use[np.argsort(place[at[use]], kind="stable")]
        row, column = row[use], place[at[use]]
        side, comp, ids = (pdf[c].to_numpy() for c in ("side", "component", "id"))
        x = np.flatnonzero(side == 0)
        y = np.flatnonzero(side == 1) if side.any() else x
        both = np.zeros((len(x), len(y)), np.int64)
        for lo in range(0, int(often.sum()), COLUMNS):
            i, k = np.searchsorted(column, [lo, lo + COLUMNS])
            seen = np.zeros((len(n), COLUMNS), np.float32)
            seen[row[i:k], column[i:k] - lo] = 1
            both += np.rint(seen[x] @ seen[y].T).astype(np.int64)
        good = (100 * both >= percent * (n[x][:, None] + n[y][None, :] - both)) & (comp[x][:, None] != comp[y][None, :])
        i, k = np.nonzero(good)
        a, b = ids[x[i]], ids[y[k]]
        # one link of two components decides: give the smallest of each
        out = pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "p": np.minimum(comp[x[i]], comp[y[k]]),
                            "q": np.maximum(comp[x[i]], comp[y[k]])})
        return out.sort_values(["a", "b"]).drop_duplicates(["p", "q"])[["a", "b"]]
    return full.groupBy("cluster", "block", "block2").applyInPandas(compare, "a long, b long").distinct()


def merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """The components after more links: only the components that these touch
    are joined anew."""
    ends = links.select(F.col("a").alias("id")).unionAll(links.select(F.col("b").alias("id"))).distinct()
    every = stored(ends.join(label, "id", "full").select("id", F.coalesce("component", "id").alias("component")), "labels")
    side = every.toDF("end", "c")
    edges = links.join(side.toDF("a", "ca"), "a").join(side.toDF("b", "cb"), "b").where("ca <> cb") \
        .select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    roots = components(edges).toDF("component", "root")
    return stored(every.join(roots, "component", "left").select("id", F.coalesce("root", "component").alias("component")),
                  "labels")


def link(docs: DataFrame, id_col: str, text_col: str, percent: int):
    """(sketch table, digest -> component of every class that has company)."""
    sketch = stored(sketches(docs, id_col, text_col), "sketch")
    # equal sets have equal bands; a class gets a number of its own, which
    # writing it fixes
    classes = stored(sketch.where("n > 0 AND id IS NOT NULL").groupBy("digest")
                     .agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
                     .withColumn("id", F.monotonically_increasing_id()), "classes")
    keyed = classes.select("id", F.explode(F.array_distinct("bands")).alias("key"))
    hot = keyed.groupBy("key").agg(F.count("*").alias("c"), F.min("id").alias("centre")).where("c > 1")
    members = stored(keyed.join(hot.select("key", "centre", "c"), "key"), "members")
    known = classes.select("id", "rep", "digest").join(members.select("id").distinct(), "id", "left_semi")
    sets = stored(set_table(docs, known, id_col, text_col), "sets")

    def ordered(x, y):
        return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")
    tested = stored(members.where("id <> centre").select(*ordered("id", "centre")).distinct(), "pairs")
    links = stored(confirmed(tested, sets, percent), "links")
    label = components(links)

    def open_keys(label, sizes):
        """Members of keys whose classes are in several components."""
        placed = members.where(sizes).join(label, "id", "left") \
            .select("key", "id", "centre", F.coalesce("component", "id").alias("component"))
        mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")) \
            .where("lo <> hi").select("key")
        return stored(placed.join(mixed, "key"), "open")

    rest = open_keys(label, f"c > 2 AND c <= {SMALL}")
    again = rest.select("key", F.col("id").alias("x"), F.col("component").alias("xc"))
    pairs = rest.join(again, "key").where("id < x AND component <> xc").select(*ordered("id", "x")).distinct()
    more = stored(confirmed(stored(pairs.join(tested, ["a", "b"], "left_anti"), "pairs"), sets, percent), "links")
    if not more.isEmpty():
        label = merged(label, more)
    rest = open_keys(label, f"c > {SMALL}")
    if not rest.isEmpty():
        # keys that share a member belong to one cluster: every member hangs
        # on its smallest centre, and so do its other centres
        star = rest.groupBy("id").agg(F.min("centre").alias("b")).select(F.col("id").alias("a"), "b")
        chain = rest.select("id", "centre").distinct().join(star.toDF("id", "b"), "id") \
            .select(F.col("centre").alias("a"), "b").where("a <> b").distinct()
        cluster = components(star.unionAll(chain)).withColumnRenamed("component", "cluster")
        placed = stored(rest.select("id", "component").distinct().join(cluster, "id"), "clusters")
        more = stored(block_links(placed, sets, percent), "links")
        if not more.isEmpty():
            label = merged(label, more)
    found = stored(classes.select("id", "digest", "rep", "copies").join(label, "id", "left")
                   .where("copies > 1 OR component IS NOT NULL"), "found")
    least = found.groupBy("component").agg(F.min("rep").alias("least"))
    found = found.join(least, "component", "left").select("digest", F.coalesce("least", "rep").alias("component"))
    return sketch, stored(found, "components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document."""
    sketch, found = link(docs, id_col, text_col, percent)
    component = F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.coalesce("component", "id"))
                       .otherwise(F.col("id")))
    return sketch.select("id", "n", "digest").join(found, "digest", "left") \
        .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each group."""
    result = stored(near_duplicates(docs, id_col, text_col, percent), "near")
    gone = result.where("NOT kept").select(id_col).distinct()
    few = gone.count() <= BROADCAST_ROWS
    left = docs.join(F.broadcast(gone) if few else gone, id_col, "left_anti")
    twice = result.where(F.col("kept") & F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1") \
        .select(id_col)
    if twice.isEmpty():
        return left
    order = Window.partitionBy(id_col).orderBy(*[c for c in docs.columns if c != id_col])
    first = left.join(twice, id_col, "left_semi").withColumn("__nth", F.row_number().over(order)) \
        .where("__nth = 1").drop("__nth").select(docs.columns)
    return left.join(twice, id_col, "left_anti").select(docs.columns).unionAll(first)
