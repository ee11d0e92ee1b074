"""Block-rule tables and their enforcement on traffic.

Rules are data, not timers: a DROP decision becomes a rule row with an
event-time ``added_at_us`` and ``expiry_us`` (NULL = permanent); unblocks and
timer expiries are derived state over that table.  Times are microseconds
since the epoch (LONG), so no session time zone is involved.

Intervals are merged and looked up by running values over range partitions
(``operators.scan``), so one address may own a third of all rules and flows, a
rule may last for years, and no row is repeated per hour or per rule:

* ``blocked_intervals`` merges each address's rules into disjoint intervals;
* ``mark_blocked`` looks up, for each flow, the last interval of its address
  that starts at or before it; being disjoint, no other can hold it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.operators import scan
from flowlens.session import reliable_checkpoint

# Fixed values of the rule table.
ACTION_DROP = "DROP"
REASON_AUTO = "auto-detect"
REASON_NO_ROOT_DEFAULT = "blocked (no-root)"
NO_ROOT_SUFFIX = " (no-root)"
LIVE_TTL_S = 600
_OPEN_END = 2 ** 62  # stands for "no expiry" inside the interval merge

RULE_COLUMNS = ["rule_id", "added_at_us", "src_ip", "dst_ip", "src_port", "dst_port", "protocol",
                "action", "expiry_us", "reason"]


def block_rules(decisions: DataFrame, ttl_s=LIVE_TTL_S, reason: str = REASON_AUTO,
                id_col: str = "rule_id", ts_col: str = "added_at_us") -> DataFrame:
    """DROP decisions -> rule rows.  ``decisions`` has ``decision``,
    ``src_ip``, ``id_col``, ``ts_col``; ``ttl_s`` is a number or a column
    name; a TTL of 0 or NULL gives a permanent rule (expiry NULL)."""
    ttl = F.col(ttl_s) if isinstance(ttl_s, str) else F.lit(ttl_s)
    d = decisions.where(F.col("decision") == ACTION_DROP)
    return d.select(
        F.col(id_col).cast("long").alias("rule_id"),
        F.col(ts_col).cast("long").alias("added_at_us"),
        F.col("src_ip"),
        F.lit(None).cast("string").alias("dst_ip"),
        F.lit(None).cast("int").alias("src_port"),
        F.lit(None).cast("int").alias("dst_port"),
        F.lit(None).cast("int").alias("protocol"),
        F.lit(ACTION_DROP).alias("action"),
        F.when(ttl > 0, F.col(ts_col) + ttl.cast("long") * 1_000_000).cast("long").alias("expiry_us"),
        F.lit(reason).alias("reason"))


def record_only(rules: DataFrame) -> DataFrame:
    """Rules recorded without touching the host firewall: one row per
    rule, reason suffixed ' (no-root)' ('blocked (no-root)' when empty)."""
    r = F.col("reason")
    return rules.withColumn("reason", F.when(r.isNull() | (r == ""), F.lit(REASON_NO_ROOT_DEFAULT))
                            .otherwise(F.concat(r, F.lit(NO_ROOT_SUFFIX))))


def apply_unblocks(rules: DataFrame, unblocks: DataFrame, ts_col: str = "unblock_us") -> DataFrame:
    """An unblock of an address at time u sets expiry = u on every rule
    of that address that exists at u (added_at <= u) and is not permanent,
    expired ones included; the last unblock wins.

    The last applicable unblock of a rule is the address's latest unblock if
    that one is not before the rule was added, so one aggregate row per
    address suffices (no rule x unblock pairs)."""
    last = unblocks.groupBy("src_ip").agg(F.max(ts_col).alias("_last_u"))
    j = rules.join(last, "src_ip", "left")
    hit = F.col("expiry_us").isNotNull() & (F.col("_last_u") >= F.col("added_at_us"))
    return j.withColumn("expiry_us", F.when(hit, F.col("_last_u")).otherwise(F.col("expiry_us"))).drop("_last_u")


def after_timers(rules: DataFrame) -> DataFrame:
    """Every timed rule schedules an unblock at its expiry; once all
    timers have fired each timed row of an address carries the latest
    timer's time.  Permanent rows are untouched."""
    last = rules.where(F.col("expiry_us").isNotNull()).groupBy("src_ip").agg(F.max("expiry_us").alias("_last"))
    j = rules.join(last, "src_ip", "left")
    return j.withColumn("expiry_us", F.when(F.col("expiry_us").isNotNull(), F.col("_last"))).drop("_last")


def active_at(rules: DataFrame, t_us) -> DataFrame:
    """Rules live at ``t_us`` (a number or a column)."""
    t = F.lit(t_us) if isinstance(t_us, int) else t_us
    return rules.where((F.col("added_at_us") <= t) & (F.col("expiry_us").isNull() | (F.col("expiry_us") > t)))


def blocked_intervals(rules: DataFrame) -> DataFrame:
    """Per address, the union of its rule intervals [added, expiry) as
    disjoint intervals (touching ones merged; NULL end = still blocked).

    Gaps and islands: a rule opens an island when it starts after every
    earlier one of its address has ended; its island is the latest island start
    at or before it.  Both are running values over range partitions."""
    end = F.coalesce(F.col("expiry_us"), F.lit(_OPEN_END))
    r = rules.select("src_ip", F.col("added_at_us").alias("s"), end.alias("e"), "rule_id")
    order = ["s", "e", "rule_id"]
    rows = scan.ordered_parts(r, ["src_ip"], order)
    rows = scan.running(rows, ["src_ip"], order, {"_prev": ("max", "e")})
    opens = F.col("_prev").isNull() | (F.col("s") > F.col("_prev"))
    rows = reliable_checkpoint(rows.withColumn("_opens", F.when(opens, F.col("s"))))
    rows = scan.running(rows, ["src_ip"], order, {"_island": ("max", "_opens")}, own=True)
    iv = rows.groupBy("src_ip", "_island").agg(F.min("s").alias("start_us"), F.max("e").alias("_e"),
                                               F.count(F.lit(1)).alias("n_rules"))
    return iv.select("src_ip", "start_us",
                     F.when(F.col("_e") < _OPEN_END, F.col("_e")).alias("end_us"), "n_rules")


def mark_blocked(traffic: DataFrame, rules: DataFrame, ts_col: str = "start_us",
                 flag: str = "blocked") -> DataFrame:
    """Flag each traffic row whose source is blocked at ``ts_col``:
    some rule of that address has added_at <= t < expiry (or no expiry).  A
    NULL source or time is never blocked."""
    iv = blocked_intervals(rules).where(F.col("src_ip").isNotNull()).select("src_ip", "start_us", "end_us")
    rows = scan.as_of(traffic, iv.withColumnRenamed("start_us", "_from"), ["src_ip"], ts_col, "_from", "_last")
    live = F.col("_last").isNotNull() & (F.col("_last.end_us").isNull() | (F.col(ts_col) < F.col("_last.end_us")))
    return rows.withColumn(flag, F.coalesce(live & F.col(ts_col).isNotNull(), F.lit(False))).drop("_last")
