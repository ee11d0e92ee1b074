"""Operator 1, chat formatting: preference pairs with masked completions.

``format_preferences`` takes a chosen and a rejected conversation per row
(arrays of turns), finds their longest common turn prefix, renders it once as
the prompt, and gives what follows in each as segments of text with a loss
flag: an assistant turn's text and end mark carry loss, its header and other
roles' turns do not.

``pair_conversations`` makes such rows from a table of turns: conversations
of the same first turn stand together.  Rare first turns share buckets by a
hash, a first turn of more than ``GROUP`` conversations is salted into
buckets of its own.  In a bucket the conversations of one first turn form
pairs by id, and only the last one of each odd group is paired with that of the
next first turn left over.  Such a pair has nothing in common; its rejected
side is derived: the chosen conversation up to its last assistant turn, which
is exchanged for the other's last one (``exchanged``; not where either has
none).  So every pair is about one prompt.  Buckets are small whatever the
data, so no task gets a hot group.

DataFrame functions only.  Defined cases: a conversation's turns are ordered
by (turn, role, text), nulls first; rows without a conversation id belong to
none; null roles and texts render as empty; the last conversation of an odd
bucket has a null ``rejected_id`` and is compared with an empty one; equal
conversations give the whole as prompt and empty completions; repeated turns
are kept; an empty table gives no pairs; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GROUP = 1024
BROADCAST_ROWS = 50_000
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
TRAINED = "assistant"


def header(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(turn["role"], F.lit("")), F.lit("\n"))


def body(turn: Column) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit(CLOSE))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(header(t), body(t))), "")


def segments(turns: Column) -> Column:
    """Two segments per turn: its header, and its text with the end mark."""
    return F.flatten(F.transform(turns, lambda t: F.array(
        F.struct(header(t).alias("text"), F.lit(False).alias("loss")),
        F.struct(body(t).alias("text"), F.coalesce(t["role"] == TRAINED, F.lit(False)).alias("loss")))))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading turns (role and text) that both arrays have."""
    n = F.least(F.size(a), F.size(b))
    differ = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
                      lambda i: ~(F.get(a, i)["role"].eqNullSafe(F.get(b, i)["role"])
                                  & F.get(a, i)["text"].eqNullSafe(F.get(b, i)["text"])))
    return F.when(n == 0, 0).otherwise(F.coalesce(F.get(differ, 0), n))


def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Adds ``prompt_turns, prompt, chosen_segments, rejected_segments`` and
    drops the two arrays."""
    with_n = pairs.withColumn("prompt_turns", common_prefix(F.col(chosen), F.col(rejected)))

    def rest(name):
        return segments(F.slice(F.col(name), F.col("prompt_turns") + 1, F.size(name)))
    return with_n.withColumn("prompt", render(F.slice(F.col(chosen), F.lit(1), F.col("prompt_turns")))) \
        .withColumn("chosen_segments", F.when(F.size(chosen) > F.col("prompt_turns"), rest(chosen)).otherwise(
            F.slice(segments(F.col(chosen)), 1, 0))) \
        .withColumn("rejected_segments", F.when(F.size(rejected) > F.col("prompt_turns"), rest(rejected)).otherwise(
            F.slice(segments(F.col(chosen)), 1, 0))) \
        .drop(chosen, rejected)


def exchanged(chosen: Column, other: Column) -> Column:
    """``chosen`` up to its last assistant turn, which is the last assistant
    turn of ``other``; ``other`` itself where either has none."""
    def last(turns):
        return F.array_max(F.filter(F.transform(turns, lambda t, i: F.when(t["role"] == TRAINED, i)), lambda i: i.isNotNull()))
    mine, theirs = last(chosen), last(other)
    return F.when(mine.isNull() | theirs.isNull(), other) \
        .otherwise(F.concat(F.slice(chosen, F.lit(1), mine), F.slice(other, theirs + 1, F.lit(1))))


def _number(text: Column) -> Column:
    """A number from the first 8 hex digits of the MD5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def pair_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                       text_col: str = "text", group: int = GROUP) -> DataFrame:
    """``chosen_id, rejected_id, chosen, rejected`` (arrays of turns)."""
    rows = turns.select(F.col(conv_col).cast("long").alias("id"), F.struct(
        F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"),
        F.col(text_col).cast("string").alias("text")).alias("t")).where("id IS NOT NULL")

    def first_turn(t):
        return F.md5(F.concat(F.coalesce(t["role"], F.lit("")), F.lit("\n"), F.coalesce(t["text"], F.lit("")))
                     .cast("binary"))
    # first turns are counted on hashes; min() of the struct orders like the arrays below
    firsts = rows.groupBy("id").agg(F.min("t").alias("t")).select("id", first_turn(F.col("t")).alias("key"))
    n = firsts.count()
    hot = firsts.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > group).checkpoint()
    buckets = max(1, -(-n // group))
    talks = rows.groupBy("id").agg(F.array_sort(F.collect_list("t")).alias("turns")) \
        .withColumn("key", first_turn(F.get("turns", F.lit(0))))
    talks = talks.join(F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot, "key", "left")
    spread = _number(F.col("id").cast("string")) % F.ceil(F.col("n") / group)
    talks = talks.withColumn("bucket", F.when(F.col("n").isNotNull(), F.concat_ws("/", "key", spread.cast("string")))
                             .otherwise((_number(F.col("key")) % buckets).cast("string")))
    # one exchange by bucket serves both windows
    alike = Window.partitionBy("bucket", "key").orderBy("id")
    talks = talks.repartition("bucket").select("id", "turns", "key", "bucket", (
        F.lead("id").over(alike).isNull() & (F.row_number().over(alike) % 2 == 1)).alias("alone"))
    # pairs of one first turn stand before the ones left over, and their number is even
    order = Window.partitionBy("bucket").orderBy("alone", "key", "id")
    paired = talks.select("id", "turns", F.row_number().over(order).alias("nth"), F.lead("id").over(order).alias("other"),
                          (F.lead("key").over(order) == F.col("key")).alias("alike"),
                          F.lead("turns").over(order).alias("other_turns")).where("nth % 2 = 1")
    rejected = F.when(F.col("alike"), F.col("other_turns")).when(
        F.col("other").isNotNull(), exchanged(F.col("turns"), F.col("other_turns"))).otherwise(F.slice("turns", 1, 0))
    return paired.select(F.col("id").alias("chosen_id"), F.col("other").alias("rejected_id"),
                         F.col("turns").alias("chosen"), rejected.alias("rejected"))


def preference_pairs(turns: DataFrame, **columns) -> DataFrame:
    """The formatted pairs of a conversation table, completions as strings:
    whole, and the part that carries loss."""
    out = format_preferences(pair_conversations(turns, **columns))

    def text(name, only_loss=False):
        part = F.filter(name, lambda s: s["loss"]) if only_loss else F.col(name)
        return F.array_join(F.transform(part, lambda s: s["text"]), "")
    return out.select("chosen_id", "rejected_id", F.col("prompt_turns").cast("long").alias("prompt_turns"), "prompt",
                      text("chosen_segments").alias("chosen"), text("rejected_segments").alias("rejected"),
                      text("chosen_segments", True).alias("chosen_loss"),
                      text("rejected_segments", True).alias("rejected_loss"))


ORACLE = f"""
WITH talks AS (
  SELECT conv_id AS id, list({{'turn': turn, 'role': role, 'text': text}}
           ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
keyed AS (SELECT id, turns, md5(coalesce(turns[1].role, '') || chr(10) || coalesce(turns[1].text, '')) AS key FROM talks),
sized AS (SELECT *, count(*) OVER (PARTITION BY key) AS n, count(*) OVER () AS total FROM keyed),
dealt AS (SELECT *, CASE WHEN n > {GROUP}
    THEN key || '/' || (('0x' || substr(md5(id::VARCHAR), 1, 8))::BIGINT % ceil(n / {GROUP})::BIGINT)::VARCHAR
    ELSE (('0x' || substr(md5(key), 1, 8))::BIGINT % greatest(1, ceil(total / {GROUP}))::BIGINT)::VARCHAR END AS bucket
  FROM sized),
marked AS (SELECT *, lead(id) OVER k IS NULL AND row_number() OVER k % 2 = 1 AS alone
  FROM dealt WINDOW k AS (PARTITION BY bucket, key ORDER BY id)),
joined AS (SELECT id, turns, row_number() OVER w AS nth, lead(id) OVER w AS other, lead(key) OVER w = key AS alike,
    coalesce(lead(turns) OVER w, turns[1:0]) AS other_turns
  FROM marked WINDOW w AS (PARTITION BY bucket ORDER BY alone, key, id)),
spoken AS (SELECT *, list_max(list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = '{TRAINED}')) AS mine,
    list_max(list_filter(range(1, len(other_turns) + 1), lambda i: other_turns[i].role = '{TRAINED}')) AS theirs FROM joined),
placed AS (SELECT id, turns, nth, other, CASE WHEN NOT alike AND mine IS NOT NULL AND theirs IS NOT NULL
    THEN list_concat(turns[1:mine - 1], [other_turns[theirs]]) ELSE other_turns END AS other_turns FROM spoken),
pairs AS (SELECT *, coalesce(list_min(list_filter(range(1, least(len(turns), len(other_turns)) + 1),
      lambda i: turns[i].role IS DISTINCT FROM other_turns[i].role OR turns[i].text IS DISTINCT FROM other_turns[i].text)) - 1,
      least(len(turns), len(other_turns))) AS p
  FROM placed WHERE nth % 2 = 1),
cut AS (SELECT id, other, p, turns[1:p] AS head, turns[p + 1:] AS c, other_turns[p + 1:] AS r FROM pairs)
SELECT id AS chosen_id, other AS rejected_id, p::BIGINT AS prompt_turns,
  coalesce(array_to_string(list_transform(head, lambda t: '{OPEN}' || coalesce(t.role, '') || chr(10) || coalesce(t.text, '') || '<|im_end|>' || chr(10)), ''), '') AS prompt,
  coalesce(array_to_string(list_transform(c, lambda t: '{OPEN}' || coalesce(t.role, '') || chr(10) || coalesce(t.text, '') || '<|im_end|>' || chr(10)), ''), '') AS chosen,
  coalesce(array_to_string(list_transform(r, lambda t: '{OPEN}' || coalesce(t.role, '') || chr(10) || coalesce(t.text, '') || '<|im_end|>' || chr(10)), ''), '') AS rejected,
  coalesce(array_to_string(list_transform(list_filter(c, lambda t: t.role = '{TRAINED}'), lambda t: coalesce(t.text, '') || '<|im_end|>' || chr(10)), ''), '') AS chosen_loss,
  coalesce(array_to_string(list_transform(list_filter(r, lambda t: t.role = '{TRAINED}'), lambda t: coalesce(t.text, '') || '<|im_end|>' || chr(10)), ''), '') AS rejected_loss
FROM cut
"""
