"""Operator 13, phrase collocation mining by prefix-free parsing.

1. Parsing.  The words of a document (with a mark where a piece ends) are cut
   into chunks by content: a chunk starts wherever the hash of the next
   ``WINDOW`` words says so, and runs on over the ``WINDOW`` words at the
   start of the next one.  Equal passages thus give equal chunks wherever
   they stand.  Chunks are counted per language into a dictionary of distinct
   chunks with parse frequencies, which is all that later passes read.
2. Counting.  An n-gram belongs to the chunk in whose own part it starts, so
   overlaps count once; a chunk counts with its frequency.  Three passes over
   the distinct chunks count words, pairs and longer phrases: an n-gram can
   only reach ``min_count`` when all its words (a pair) or all its pairs (a
   longer one) do.  Which of those do is told by a bitmap of at most
   2**``MAP_BITS`` bits (a fixed broadcast bound); where a bitmap says yes
   wrongly, the n-gram is counted exactly all the same and falls to
   ``min_count``, so counts are exact at any size.
3. Scoring.  Parts of a candidate are shorter n-grams that are known, so their
   counts are joined; products are decimals of 38 digits.

Words are told apart by a 64-bit hash of language and word.  After the first
pass one grouping over all distinct words proves that no two share a hash;
if two did, another seed would be taken.

Hot languages, passages or words: rows are summed inside each slice and again
before each shuffle, and no step holds a language, word or phrase in one task
but for the last ``top`` rows of a language, taken from at most ``SALTS`` times
as many.

Defined cases: a null language is ``und``, a null text is empty; repeated rows
count as often as they occur; ties in score and count go by phrase in UTF-8
byte order; an empty table gives an empty result; other columns are not read.
Memory of a task follows ``SLICE_BYTES``; a longer text is cut at ends of
pieces, so only a single longer piece stays whole.
"""

from __future__ import annotations

from array import array
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from flowlens.llm.common import bounded_batches, slices, stored, whole_text

MAX_WORDS = 5
MIN_COUNT = 100
TOP = 2000
#: Words of the window that starts a chunk; at least MAX_WORDS - 1.
WINDOW = 4
#: Words of a chunk on average.
CHUNK_WORDS = 32
SLICE_BYTES = 8 << 20
MAP_BITS = 28
SALTS = 64
SEEDS = 16

NO_LANG = "und"
#: Bytes that UTF-8 text never holds: end of a piece, end of a document or chunk.
_PIECE, _END = b"\xff", b"\xfe"
#: In the stored chunks: end of a piece, and where the words of the next chunk
#: begin (both split pieces, so no word holds them).
_STOP, _NEXT = b"\n", b"\x0b"
# The characters that end a piece, and the other white space between words.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(_ENDS + b"\t", _PIECE * len(_ENDS) + b" ")
# Odd 64-bit factors of the hashes.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _numbered(tokens: list[bytes]):
    """A number for each token, and the distinct tokens by number."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    found = array("i", map(number.__getitem__, tokens))
    return np.frombuffer(found, np.int32), number


def _cut(text: bytes) -> list[bytes]:
    """A marked text, cut at ends of pieces into stretches of bounded size."""
    out, at = [], 0
    while len(text) - at > SLICE_BYTES:
        end = text.find(_PIECE, at + SLICE_BYTES)
        if end < 0:
            break
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def parse(text: bytes) -> list[bytes]:
    """Chunks of one document; see :func:`parse_all`."""
    return [c for _, c in parse_all([text])]


def parse_all(texts: list[bytes]) -> list[tuple[int, bytes]]:
    """(index of the text, chunk) for every chunk.  A chunk is its own words,
    ``_NEXT``, and the words of the next chunk that its n-grams may reach, all
    joined by spaces; ``_STOP`` ends a piece."""
    marked = [(n, part) for n, t in enumerate(texts) for part in _cut(t.lower().translate(_TABLE))]
    tokens = (b" " + _END + b" ").join([t.replace(_PIECE, b" " + _PIECE + b" ") for _, t in marked]).split()
    if not tokens:
        return []
    ids, number = _numbered(tokens)
    end = ids == number.get(_END, -1)
    piece = ids == number.get(_PIECE, -1)
    # one mark between pieces is enough
    keep = ~(piece & np.r_[True, (piece | end)[:-1]])
    ids, end, piece = ids[keep], end[keep], piece[keep]
    tokens = [t for t, k in zip(tokens, keep.tolist()) if k]
    n = len(ids)
    hashes = np.array([xxhash.xxh64_intdigest(t) for t in number], np.uint64)
    window = np.zeros(n, np.uint64)
    inside = np.ones(n, bool)
    for k in range(WINDOW):
        at = min(k, n)
        window[:n - at] += hashes[ids[at:]] * _MIX[k]
        inside[:n - at] &= ~end[at:]
        inside[n - at:] = False
    window = (window ^ (window >> np.uint64(29))) * _MIX[1]
    first = np.r_[True, end[:-1]] & ~end
    start = (inside & ((window >> np.uint64(33)) % np.uint64(CHUNK_WORDS) == 0)) | first
    starts = np.flatnonzero(start | end)
    stops = np.r_[starts[1:], n]
    text_of = np.cumsum(end)[starts].tolist()
    ends, pieces = end.tolist(), piece.tolist()
    out = []
    for s, e, d in zip(starts.tolist(), stops.tolist(), text_of):
        if ends[s]:
            continue
        reach = e
        if e < n and not pieces[e - 1]:
            while reach < min(e + WINDOW, n) and not ends[reach] and not pieces[reach]:
                reach += 1
        out.append((marked[d][0], b" ".join([*tokens[s:e], _NEXT, *tokens[e:reach]]).replace(_PIECE, _STOP)))
    return out


class Grams:
    """Words of many chunks of one language, as arrays over word places."""

    def __init__(self, lang: bytes, chunks: list[bytes], counts: np.ndarray, seed: int):
        tokens = (b" " + _END + b" ").join(chunks).split(b" ") if chunks else []
        ids, number = _numbered(tokens)
        end, next_ = ids == number.get(_END, -1), ids == number.get(_NEXT, -1)
        own = (np.cumsum(next_) - np.cumsum(end)) == 0
        chunk = np.cumsum(end)
        keep = ~next_
        self.ids, self.stop = ids[keep], (end | (ids == number.get(_STOP, -1)))[keep]
        self.own = own[keep] & ~self.stop
        self.weight = counts[chunk[keep]]
        self.words = list(number)
        self.hash = np.array([xxhash.xxh64_intdigest(lang + _PIECE + w, seed) for w in self.words], np.uint64)

    def totals(self):
        """Word, hash and occurrences of the distinct words that start here."""
        n = np.zeros(len(self.words), np.int64)
        np.add.at(n, self.ids[self.own], self.weight[self.own])
        at = np.flatnonzero(n)
        return [self.words[i] for i in at], self.hash[at], n[at]

    def passing(self, part: int, frequent) -> np.ndarray:
        """Of each place: whether the ``part`` words that start there pass
        ``frequent`` (by their hashes)."""
        words = self.hash[self.ids]
        n = max(len(words) - part + 1, 0)
        return frequent(folded([words[j:n + j] for j in range(part)]))

    def counted(self, k: int, part: int, passes: np.ndarray):
        """Hashes of the words (k columns) and occurrences of the distinct
        n-grams of ``k`` words all of whose n-grams of ``part`` words pass."""
        n = len(self.ids) - k + 1
        if n <= 0:
            return np.zeros((0, k), np.uint64), np.zeros(0, np.int64)
        places = self.own[:n].copy()
        for j in range(1, k):
            places &= ~self.stop[j:n + j]
        for j in range(k - part + 1):
            places &= passes[j:n + j]
        at = np.flatnonzero(places)
        if not len(at):
            return np.zeros((0, k), np.uint64), np.zeros(0, np.int64)
        # exact grouping: the local word numbers of a place as one number
        key, size, most = self.ids[at].astype(np.int64), len(self.words), len(self.words)
        for j in range(1, k):
            if most * size >= 1 << 62:
                distinct, key = np.unique(key, return_inverse=True)
                most = len(distinct)
            key, most = key * size + self.ids[at + j], most * size
        _, first, group = np.unique(key, return_index=True, return_inverse=True)
        total = np.zeros(len(first), np.int64)
        np.add.at(total, group, self.weight[at])
        return np.stack([self.hash[self.ids[at[first] + j]] for j in range(k)], axis=1), total


def folded(columns: list[np.ndarray]) -> np.ndarray:
    """One 64-bit hash of the word hashes in each row."""
    out = columns[0]
    for c in columns[1:]:
        out = (out * _MIX[0] + c) * _MIX[1]
        out = out ^ (out >> np.uint64(31))
    return out


def places(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes * _MIX[3]) >> np.uint64(64 - bits)


def _arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` of ``fn(slice) -> iterable of lists of arrays``."""
    ddl = StructType.fromDDL(schema)
    bounded_batches(df.sparkSession)

    def run(batches):
        out = to_arrow_schema(ddl)
        for batch in batches:
            for part in slices(batch, SLICE_BYTES):
                for arrays in fn(part):
                    yield pa.RecordBatch.from_arrays([pa.array(a, f.type) for a, f in zip(arrays, out)], schema=out)
    return df.mapInArrow(run, ddl)


def dictionary(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, chunk, n``: the distinct chunks with their parse frequencies."""
    def run(part: pa.RecordBatch):
        langs = part.column(0).to_pylist()
        found = Counter((langs[i], c) for i, c in parse_all(part.column(1).to_pylist()))
        yield [k[0] for k in found], [k[1] for k in found], list(found.values())
    picked = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"),
                       whole_text(text_col).cast("binary").alias("text"))
    return _arrow(picked, run, "lang string, chunk binary, n long") \
        .groupBy("lang", "chunk").agg(F.sum("n").alias("n"))


def _by_lang(part: pa.RecordBatch, seed: int):
    langs = np.array(part.column(0).to_pylist(), object)
    chunks = np.array(part.column(1).to_pylist(), object)
    counts = part.column(2).to_numpy(zero_copy_only=False)
    for lang in dict.fromkeys(langs.tolist()):
        mine = langs == lang
        yield lang, Grams(lang.encode(), chunks[mine].tolist(), counts[mine], seed)


def _signed(hashes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(hashes).view(np.int64)


def word_counts(chunks: DataFrame) -> tuple[DataFrame, int]:
    """``lang, word, h1, a`` of all distinct words, stored, and the seed under
    which all their hashes differ."""
    for seed in range(SEEDS):
        def run(part: pa.RecordBatch, seed=seed):
            for lang, grams in _by_lang(part, seed):
                words, hashes, n = grams.totals()
                yield [lang] * len(words), words, _signed(hashes), n
        words = stored(_arrow(chunks, run, "lang string, word binary, h1 long, n long")
                       .groupBy("lang", "word", "h1").agg(F.sum("n").alias("a")), "words")
        if words.groupBy("h1").count().where("count > 1").isEmpty():
            return words, seed
    raise RuntimeError("no seed keeps the words apart")  # pragma: no cover


def bitmap(grams: DataFrame, n: int, max_bits: int = MAP_BITS) -> tuple[np.ndarray, int]:
    """The bits of the n-grams in ``grams`` (``n`` rows, equal lengths): one in
    32 bits is set, or more beyond ``max_bits``.  At most 2**``max_bits`` / 8
    bytes."""
    bits = min(max_bits, max(15, (32 * n - 1).bit_length()))

    def run(part: pa.RecordBatch):
        keys = part.column(0)
        columns = keys.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(keys), -1)
        yield [_signed(places(folded(list(columns.T)), bits)) + 1]
    at = _arrow(grams.select("key"), run, "at long")
    blocks = at.groupBy(F.bitmap_bucket_number("at").alias("block")) \
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for block, found in blocks.toLocalIterator():
        out[(block - 1) * 4096:block * 4096] = np.frombuffer(found, np.uint8)
    return out, bits


def gram_counts(chunks: DataFrame, ks: range, seed: int, shorter: DataFrame, part: int, min_count: int,
                max_bits: int = MAP_BITS) -> DataFrame | None:
    """``key`` (hashes of the words), ``a`` of the n-grams of ``ks`` words with
    a count of at least ``min_count``, stored; ``shorter`` are those of
    ``part`` words."""
    n = shorter.count()
    if not n:
        return None
    found, bits = bitmap(shorter, n, max_bits)
    sent = chunks.sparkSession.sparkContext.broadcast(found)
    names = [f"h{j + 1}" for j in range(ks[-1])]

    def run(rows: pa.RecordBatch):
        def frequent(hashes):
            at = places(hashes, bits)
            return (sent.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        for _, grams in _by_lang(rows, seed):
            passes = grams.passing(part, frequent)
            for k in ks:
                hashes, total = grams.counted(k, part, passes)
                nothing = pa.nulls(len(total), pa.int64())
                yield [*[_signed(hashes[:, j]) if j < k else nothing for j in range(len(names))], total]
    rows = _arrow(chunks, run, ", ".join(f"{h} long" for h in names) + ", n long")
    counts = rows.groupBy(*names).agg(F.sum("n").alias("a")).where(F.col("a") >= min_count)
    return stored(counts.select(F.array_compact(F.array(*names)).alias("key"), "a"), f"grams{ks[-1]}")


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT,
                 top: int = TOP, max_bits: int = MAP_BITS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's first
    ``top`` collocations."""
    chunks = stored(dictionary(df, text_col, lang_col), "chunks")
    words, seed = word_counts(chunks)
    of_lang = words.groupBy("lang").agg(F.sum("a").alias("n"))
    frequent = words.where(F.col("a") >= min_count)
    known = frequent.select(F.array("h1").alias("key"), "a")
    pairs = gram_counts(chunks, range(2, 3), seed, known, 1, min_count, max_bits)
    if pairs is not None:
        known = known.unionByName(pairs)
        phrases = gram_counts(chunks, range(3, MAX_WORDS + 1), seed, pairs, 2, min_count, max_bits)
        known = known if phrases is None else known.unionByName(phrases)
    longer = known.where(F.size("key") > 1)
    size = F.size("key")

    # covered: a longer n-gram of one more word has the same count (what holds
    # for any longer one, as counts can only fall with each word)
    ends = F.array(F.slice("key", F.lit(1), size - 1), F.slice("key", F.lit(2), size - 1))
    covers = longer.where(size > 2).select(F.explode(ends).alias("key"), F.col("a").alias("more")) \
        .groupBy("key").agg(F.max("more").alias("more"))
    left = longer.join(covers, "key", "left").where(F.col("more").isNull() | (F.col("more") < F.col("a"))).drop("more")

    spelled = left.select("key", "a", F.posexplode("key").alias("at", "h1")) \
        .join(frequent.select("h1", "lang", "word"), "h1") \
        .groupBy("key", "a").agg(F.max("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))
    spelled = spelled.select("key", "a", "lang", F.concat_ws(" ", F.transform("w", lambda x: x["word"].cast("string")))
                             .alias("phrase")).join(of_lang, "lang")

    cuts = spelled.select("*", F.explode(F.sequence(F.lit(1), size - 1)).alias("cut"))
    cuts = cuts.withColumns({"lkey": F.slice("key", F.lit(1), F.col("cut")),
                             "rkey": F.slice("key", F.col("cut") + 1, size - F.col("cut"))})
    cuts = cuts.join(known.select(F.col("key").alias("lkey"), F.col("a").alias("l")), "lkey") \
        .join(known.select(F.col("key").alias("rkey"), F.col("a").alias("r")), "rkey")
    best = cuts.withColumn("score", score_column()).groupBy("lang", "phrase", "a", "n") \
        .agg(F.min(F.struct("score", "cut", "l", "r")).alias("best")) \
        .select("lang", "phrase", "a", "n", "best.score", "best.l", "best.r")
    return ranked(best, top)


def score_column():
    """floor(1000 * a * n / (l * r)), exact up to 38 digits."""
    a, n, left, right = (F.col(c).cast("decimal(17,0)") for c in "anlr")
    above = (a * n).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)")
    return F.call_function("div", above.cast("decimal(38,0)"), (left * right).cast("decimal(38,0)"))


def ranked(scored: DataFrame, top: int, salts: int = SALTS) -> DataFrame:
    """The first ``top`` rows of each language, ranked: first inside salted
    parts of a language, then over what is left of them."""
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]

    def first(df, *by):
        return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))) \
            .where(F.col("rank") <= top)
    part = first(scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts))), "lang", "salt")
    return first(part.drop("rank", "salt"), "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle_sql(min_count: int = MIN_COUNT, top: int = TOP) -> str:
    """DuckDB SQL for the result over ``documents``."""
    upper = "".join(chr(c) for c in range(ord("A"), ord("Z") + 1))
    return f"""WITH t AS (SELECT coalesce(lang, '{NO_LANG}') AS lang,
  translate(coalesce(text, ''), '{upper}', '{upper.lower()}') AS text FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS p FROM t),
w AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS ws FROM pieces),
spots AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
f AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*)::BIGINT AS a
  FROM spots, (SELECT unnest(range(1, {MAX_WORDS + 1})) AS k) WHERE i + k - 1 <= len(ws) GROUP BY ALL),
tot AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= {min_count}),
inner_at AS (SELECT lang, a, ws, k, unnest(range(2, k)) AS m FROM c WHERE k > 2),
inner_of AS (SELECT lang, a, ws, m, unnest(range(1, k - m + 2)) AS s FROM inner_at),
covered AS (SELECT lang, array_to_string(ws[s:s + m - 1], ' ') AS phrase, max(a) AS more FROM inner_of GROUP BY ALL),
left_ AS (SELECT c.* FROM c LEFT JOIN covered v ON v.lang = c.lang AND v.phrase = c.phrase
  WHERE v.more IS NULL OR 100 * v.more < 100 * c.a),
cut AS (SELECT lang, phrase, a, ws, k, unnest(range(1, k)) AS x FROM left_),
s AS (SELECT cut.lang, cut.phrase, cut.a, x, l.a AS l, r.a AS r, n,
  (1000::HUGEINT * cut.a * n // (l.a::HUGEINT * r.a))::BIGINT AS score
  FROM cut JOIN tot ON tot.lang = cut.lang
  JOIN f l ON l.lang = cut.lang AND l.phrase = array_to_string(ws[1:x], ' ')
  JOIN f r ON r.lang = cut.lang AND r.phrase = array_to_string(ws[x + 1:], ' ')),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, x) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
  phrase, a, l, r, n, score FROM best
QUALIFY rank <= {top}"""
