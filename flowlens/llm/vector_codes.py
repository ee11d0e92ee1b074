"""Operator 11, vector code compression: product codes by exact integer rounds.

A vector's components become integers, the vector is cut into ``PARTS`` parts,
and each part position has a codebook of ``ENTRIES`` entries that ``ROUNDS``
rounds of nearest-entry assignment and floored means refine.

The parts of each position are sorted along a Hilbert curve and stored once as
flat blocks of at most ``BLOCK`` parts, each with its box (componentwise
minimum and maximum) and its componentwise sum.  In a round the least and the
greatest distance of a block's box to every entry leave a shortlist: entries
whose least distance is above the smallest greatest distance cannot be nearest
to any part of the block.  A shortlist of one takes the whole block by its
stored sum; otherwise an integer kernel compares the block's parts with the
shortlisted entries.  Distances stay in 64-bit integers while they fit and in
Python's integers beyond that, so assignments, ties and means are exact.

A round is one pass over the blocks; what comes back are the sums and counts
of the entries (ENTRIES x dimension numbers, whatever the input).  Blocks are
dealt by ranges of (position, Hilbert key, row), so equal vectors spread, too.

Defined cases: rows with a null vector, or a null or non-finite component, are
dropped, and so are vectors whose length is not that of the vector with the
smallest id; a length that ``PARTS`` does not divide is cut as evenly as it
can be.  Rows are ordered by id (nulls last), then by vector; a repeated id
counts as often as it occurs.  Fewer rows than ``ENTRIES`` give so many entries.
Integers beyond 64 bits are clamped there; an error beyond 64 bits is null.  An
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from flowlens.llm.common import bounded_batches, slices, stored

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Parts of a block.
BLOCK = 256
#: Bits of a Hilbert key.
KEY_BITS = 62
SLICE_BYTES = 4 << 20
#: Labels whose summed errors are broadcast.
FEW_LABELS = 200_000
_SAFE = 1 << 62


def bounds(dims: int, parts: int) -> list[int]:
    """Where the parts of a vector begin, and its end."""
    return [i * dims // parts for i in range(parts + 1)]


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of unsigned integers of
    ``bits`` bits (rows x dimensions times bits at most 63)."""
    n, dims = points.shape
    if not dims:
        return np.zeros(n, np.int64)
    x = [points[:, i].astype(np.int64) for i in range(dims)]
    # from the coarsest bit down: turn and reflect the finer bits of each cube
    for b in range(bits - 1, 0, -1):
        bit, fine = 1 << b, (1 << b) - 1
        for i in range(dims):
            upper = x[i] & bit != 0
            swap = np.where(upper, 0, (x[0] ^ x[i]) & fine)
            x[0] = np.where(upper, x[0] ^ fine, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, dims):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros(n, np.int64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (1 << b) != 0, (1 << b) - 1, 0)
    key = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | ((x[i] ^ turn) >> b) & 1
    return key


def curve_keys(points: np.ndarray, low: int, high: int) -> np.ndarray:
    """Hilbert keys of integer rows that lie between ``low`` and ``high``."""
    points = points[:, :KEY_BITS]
    bits = min(16, KEY_BITS // max(points.shape[1], 1))
    step = max(float(high) - float(low), 1.0)
    cells = ((points.astype(np.float64) - float(low)) / step * ((1 << bits) - 1)).astype(np.int64)
    return hilbert(np.clip(cells, 0, (1 << bits) - 1), bits)


def _plain(book: np.ndarray, *arrays: np.ndarray) -> bool:
    """Whether squared distances between these values fit 64 bits."""
    most = max([0, *(int(abs(int(v))) for a in (book, *arrays) if a.size for v in (a.min(), a.max()))])
    return book.shape[1] * (2 * most) ** 2 < _SAFE


def shortlists(low: np.ndarray, high: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Of each box (rows of ``low`` and ``high``): which entries may be the
    nearest one of a point inside."""
    lo, hi, c = low[:, None, :], high[:, None, :], book[None]
    outside = np.maximum(np.maximum(lo - c, c - hi), 0)
    farthest = np.maximum(abs(c - lo), abs(hi - c))
    least, most = (outside * outside).sum(2), (farthest * farthest).sum(2)
    return least <= most.min(1)[:, None]


def nearest(points: np.ndarray, book: np.ndarray, among: np.ndarray):
    """Entry and squared distance of each point; ties go to the lower entry."""
    gap = points[:, None, :] - book[among][None]
    dist = (gap * gap).sum(2)
    best = dist.argmin(1)
    return among[best], dist[np.arange(len(points)), best]


def _arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` of ``fn(slices of a partition) -> lists of arrays``."""
    ddl = StructType.fromDDL(schema)
    bounded_batches(df.sparkSession)

    def run(batches):
        out = to_arrow_schema(ddl)
        for arrays in fn(part for batch in batches for part in slices(batch, SLICE_BYTES)):
            yield pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a, f.type)
                                              for a, f in zip(arrays, out)], schema=out)
    return df.mapInArrow(run, ddl)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def integer_rows(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """``id, label, x``: kept rows with their integer components."""
    x = F.col(vec_col).cast("array<double>")
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return df.where(F.col(vec_col).isNotNull() & ~odd).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"),
        F.transform(x, lambda v: F.floor(v * F.lit(float(SCALE)))).alias("x"))


def blocks(rows: DataFrame, dims: int, parts: int = PARTS, block: int = BLOCK) -> DataFrame:
    """``part, n, low, high, total, uids, x``: the Hilbert-sorted blocks (flat
    64-bit integers as bytes) of rows ``uid, x``."""
    edges = bounds(dims, parts)
    spans = [(F.slice("x", a + 1, b - a) if b > a else None) for a, b in zip(edges, edges[1:])]
    found = rows.agg(F.count(F.lit(1)), *[f(g(s)) if s is not None else F.lit(0).cast("long")
                                          for s in spans for f, g in ((F.min, F.array_min), (F.max, F.array_max))]).first()
    limits = [(found[1 + 2 * p] or 0, found[2 + 2 * p] or 0) for p in range(parts)]

    def keyed(batches):
        for part in batches:
            uid, x = part.column(0), _matrix(part.column(1), dims)
            for p, (a, b) in enumerate(zip(edges, edges[1:])):
                own = np.ascontiguousarray(x[:, a:b])
                yield [np.full(len(own), p, np.int32), curve_keys(own, *limits[p]), uid, [r.tobytes() for r in own]]

    def cut(batches):
        for batch in batches:
            part = batch.column(0).to_numpy(zero_copy_only=False)
            uid = batch.column(2).to_numpy(zero_copy_only=False)
            data = batch.column(3).to_pylist()
            edge = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]).tolist() + [len(part)]
            out = [[] for _ in range(7)]
            for s, e in zip(edge, edge[1:]):
                p = int(part[s])
                for at in range(s, e, block):
                    to = min(at + block, e)
                    x = np.frombuffer(b"".join(data[at:to]), np.int64).reshape(to - at, edges[p + 1] - edges[p])
                    total = x.astype(object).sum(0) if _big(x) else x.sum(0)
                    for column, v in zip(out, (p, to - at, x.min(0).tobytes(), x.max(0).tobytes(),
                                               [Decimal(int(v)) for v in total], uid[at:to].tobytes(), x.tobytes())):
                        column.append(v)
            yield out
    keys = _arrow(rows.select("uid", "x"), keyed, "part int, key long, uid long, x binary")
    return _arrow(keys.repartitionByRange("part", "key", "uid").sortWithinPartitions("part", "key", "uid"), cut,
                  "part int, n int, low binary, high binary, total array<decimal(38,0)>, uids binary, x binary")


def _big(x: np.ndarray) -> bool:
    return x.size > 0 and max(abs(int(x.min())), abs(int(x.max()))) * len(x) >= _SAFE


def _shortlisted(batch: pa.RecordBatch, books: list[np.ndarray]):
    """(position, row of the batch, shortlisted entries, points, codebook) of
    each block of a batch; points and codebook are of Python's integers where
    squared distances pass 64 bits."""
    part = batch.column("part").to_numpy(zero_copy_only=False)
    low, high = batch.column("low").to_pylist(), batch.column("high").to_pylist()
    data, n = batch.column("x").to_pylist(), batch.column("n").to_pylist()
    for p in np.unique(part).tolist():
        book = books[p]
        dims = book.shape[1]
        at = np.flatnonzero(part == p)
        lo, hi = (np.frombuffer(b"".join([v[i] for i in at]), np.int64).reshape(len(at), dims) for v in (low, high))
        plain = _plain(book, lo, hi)
        if not plain:
            lo, hi, book = lo.astype(object), hi.astype(object), book.astype(object)
        for i, short in zip(at.tolist(), shortlists(lo, hi, book)):
            among = np.flatnonzero(short)
            x = np.frombuffer(data[i], np.int64).reshape(n[i], dims)
            yield p, i, among, x if plain else x.astype(object), book


def _round(blocks_: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round."""
    def sums(batches):
        total = [np.zeros(b.shape, object) for b in books]
        count = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            stored_sums, n = batch.column("total"), batch.column("n").to_pylist()
            for p, i, among, x, book in _shortlisted(batch, books):
                if len(among) == 1:
                    count[p][among[0]] += n[i]
                    total[p][among[0]] += np.array([int(v) for v in stored_sums[i].as_py()], object)
                    continue
                entry, _ = nearest(x, book, among)
                for e in np.unique(entry).tolist():
                    own = x[entry == e]
                    count[p][e] += len(own)
                    total[p][e] += (own.astype(object) if _big(own) else own).sum(0).astype(object)
        rows = [(p, e, j, int(count[p][e]), Decimal(int(total[p][e][j])))
                for p, b in enumerate(books) for e in np.flatnonzero(count[p]).tolist() for j in range(b.shape[1])]
        if rows:
            yield list(zip(*rows))
    made = _arrow(blocks_.select("part", "n", "low", "high", "total", "x"), sums,
                  "part int, entry int, at int, n long, total decimal(38,0)") \
        .groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    out = [b.copy() for b in books]
    for r in made.collect():  # at most one row per number of the codebooks
        out[r["part"]][r["entry"], r["at"]] = int(r["total"]) // r["n"]
    return out


def fit(rows: DataFrame, blocks_: DataFrame, dims: int, parts: int = PARTS, entries: int = ENTRIES,
        rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks of each part position (entries x width)."""
    first = rows.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    start = np.array([r["x"] for r in first], np.int64).reshape(len(first), dims)
    edges = bounds(dims, parts)
    books = [np.ascontiguousarray(start[:, a:b]) for a, b in zip(edges, edges[1:])]
    for _ in range(rounds):
        books = _round(blocks_, books)
    return books


def codes(blocks_: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """``uid, code, error``: the last assignment, one row per vector."""
    def assign(batches):
        for batch in batches:
            uids = batch.column("uids").to_pylist()
            for p, i, among, x, book in _shortlisted(batch, books):
                entry, dist = nearest(x, book, among)
                error = [Decimal(int(v)) for v in dist] if dist.dtype == object else pa.array(dist).cast(pa.decimal128(38, 0))
                yield [np.frombuffer(uids[i], np.int64), np.full(len(x), p, np.int32), entry.astype(np.int32), error]
    made = _arrow(blocks_.select("part", "n", "low", "high", "uids", "x"), assign,
                  "uid long, part int, entry int, error decimal(38,0)")
    digits = [F.lpad(F.lower(F.hex(F.max(F.when(F.col("part") == p, F.col("entry"))).cast("long"))), 2, "0")
              for p in range(len(books))]
    return made.groupBy("uid").agg(F.concat(*digits).alias("code"), F.sum("error").alias("error"))


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()


def compress(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, block: int = BLOCK) -> DataFrame:
    """``id_col, code, error, label_error, codebooks_sha256`` of each kept row."""
    rows = integer_rows(df, id_col, vec_col, label_col)
    least = rows.orderBy(F.col("id").asc_nulls_last(), "x").select(F.size("x")).first()
    dims = least[0] if least else 0
    # row numbers are fixed by writing them
    rows = stored(rows.where(F.size("x") == dims).withColumn("uid", F.monotonically_increasing_id()), "vectors")
    cut = stored(blocks(rows, dims, parts, block), "blocks")
    books = fit(rows, cut, dims, parts, entries, rounds)
    out = stored(rows.select("uid", F.col("id").alias(id_col), F.col("label").alias("_label"))
                 .join(codes(cut, books), "uid").drop("uid"), "codes")
    labels = out.groupBy(F.col("_label").alias("_same")).agg(F.sum("error").alias("label_error"))
    if labels.limit(FEW_LABELS + 1).count() <= FEW_LABELS:
        labels = F.broadcast(labels)
    as_long = "try_cast({0} as bigint) as {0}".format
    return out.join(labels, F.col("_label").eqNullSafe(F.col("_same"))).selectExpr(
        id_col, "code", as_long("error"), as_long("label_error"), f"'{digest(books)}' as codebooks_sha256")


def oracle_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """DuckDB SQL for the result over ``embeddings`` (unique ids, one length)."""
    ctes = [f"""e AS MATERIALIZED (SELECT vec_id, label, len(embedding) AS n, unnest(embedding)::DOUBLE AS x,
  generate_subscripts(embedding, 1) - 1 AS d FROM embeddings WHERE embedding IS NOT NULL),
v AS MATERIALIZED (SELECT vec_id, label, d // (n // {parts}) AS p, d % (n // {parts}) AS j, floor(x * {SCALE})::BIGINT AS x
  FROM e WHERE vec_id NOT IN (SELECT vec_id FROM e WHERE x IS NULL OR NOT isfinite(x))),
top AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM (SELECT DISTINCT vec_id FROM v)
  QUALIFY e < {entries}),
b0 AS MATERIALIZED (SELECT p, e, j, x AS c FROM v JOIN top USING (vec_id))"""]
    for r in range(1, rounds + 2):
        ctes.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, label, p, e, dist FROM
  (SELECT vec_id, any_value(label) AS label, p, e, sum((x - c) * (x - c)) AS dist
   FROM v JOIN b{r - 1} USING (p, j) GROUP BY vec_id, p, e)
  QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY dist, e) = 1)""")
        if r <= rounds:
            ctes.append(f"""s{r} AS (SELECT p, e, j, sum(x) AS s, count(*) AS n FROM v JOIN a{r} USING (vec_id, p) GROUP BY p, e, j),
b{r} AS MATERIALIZED (SELECT b.p, b.e, b.j, coalesce((s - (s % n + n) % n) // n, b.c)::BIGINT AS c
  FROM b{r - 1} b LEFT JOIN s{r} s ON s.p = b.p AND s.e = b.e AND s.j = b.j)""")
    return "WITH " + ",\n".join(ctes) + f""",
o AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', e::BIGINT), '' ORDER BY p) AS code,
  sum(dist)::BIGINT AS error FROM a{rounds + 1} GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, j)) FROM b{rounds}) AS codebooks_sha256 FROM o"""
