"""Cohort, note, time-series, pivot, code, score and comparison queries over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import compat
from tessera.operators import codes, cohort, compare, pivot, score, timeops
from tessera.plans.base import Tables, registrar
from tessera.sources import catalog

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
query = registrar(QUERIES, ORACLES)

# ---- cohorts ----


def _types(t: Tables) -> DataFrame:
    """Customer and the part types that they ordered, as a person's diagnosis codes."""
    parts = t.part.select("p_partkey", "p_type")
    lines = t.lineitem.select("l_orderkey", "l_partkey").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("c_custkey", "p_type")


def _cohort(t: Tables) -> DataFrame:
    people = t.customer.select("c_custkey", "c_mktsegment", F.floor("c_acctbal").cast("int").alias("age"))
    rules = cohort.Criteria(age_min=0, age_max=8000, prefixes=("PROMO", "ECONOMY"), has_event=True)
    urgent = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return cohort.select_cohort(people, "c_custkey", "age", "c_mktsegment", _types(t), "p_type", urgent, rules)


COHORT_SQL = """
WITH people AS (SELECT c_custkey, c_mktsegment, CAST(floor(c_acctbal) AS INTEGER) AS age FROM customer),
chosen AS (
  SELECT * FROM people p WHERE age BETWEEN 0 AND 8000
    AND EXISTS (SELECT 1 FROM orders o JOIN lineitem l ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey
                WHERE o_custkey = p.c_custkey AND (p_type LIKE 'PROMO%' OR p_type LIKE 'ECONOMY%'))
    AND EXISTS (SELECT 1 FROM orders o WHERE o_custkey = p.c_custkey AND o_orderpriority = '1-URGENT'))
"""


@query("cohort_counts", COHORT_SQL + "SELECT count(DISTINCT c_custkey) AS n, count(DISTINCT c_mktsegment) AS segments FROM chosen")
def cohort_counts(t: Tables) -> DataFrame:
    return _cohort(t).agg(F.count_distinct("c_custkey").alias("n"), F.count_distinct("c_mktsegment").alias("segments"))


@query(
    "cohort_bands",
    COHORT_SQL
    + """SELECT CASE WHEN age < 1000 THEN '0-999' WHEN age >= 8000 THEN '8000+'
  ELSE CAST(CAST(floor(age / 1000) * 1000 AS INTEGER) AS VARCHAR) || '-' || CAST(CAST(floor(age / 1000) * 1000 AS INTEGER) + 999 AS VARCHAR) END AS band,
  count(DISTINCT c_custkey) AS n FROM chosen GROUP BY 1""",
)
def cohort_bands(t: Tables) -> DataFrame:
    return cohort.age_bands(_cohort(t), "c_custkey", "age", first=1000, step=1000, last=8000)


@query("cohort_segment", COHORT_SQL + "SELECT c_mktsegment, count(*) AS n FROM chosen GROUP BY 1")
def cohort_segment(t: Tables) -> DataFrame:
    return _cohort(t).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("cohort_without_events", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'P')")
def cohort_without_events(t: Tables) -> DataFrame:
    urgent = t.orders.where("o_orderpriority = '1-URGENT' and o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(urgent, "c_custkey", "left_anti").select("c_custkey")


@query(
    "smd_flow",
    """WITH m AS (SELECT c_acctbal AS x, CAST(c_nationkey AS DOUBLE) AS y, c_mktsegment = 'BUILDING' AS k FROM customer),
s AS (SELECT avg(x) FILTER (WHERE k) AS xa, var_samp(x) FILTER (WHERE k) AS xv, avg(x) FILTER (WHERE NOT k) AS xb, var_samp(x) FILTER (WHERE NOT k) AS xw,
             avg(y) FILTER (WHERE k) AS ya, var_samp(y) FILTER (WHERE k) AS yv, avg(y) FILTER (WHERE NOT k) AS yb, var_samp(y) FILTER (WHERE NOT k) AS yw FROM m)
SELECT 'c_acctbal' AS variable_name, round((xa - xb) / sqrt((xv + xw) / 2), 6) AS smd FROM s
UNION ALL SELECT 'c_nationkey', round((ya - yb) / sqrt((yv + yw) / 2), 6) FROM s""",
)
def smd_flow(t: Tables) -> DataFrame:
    flow = cohort.exclusion_bias(t.customer, F.col("c_mktsegment") == "BUILDING", ["c_acctbal", "c_nationkey"])
    return flow.select("variable_name", F.round("smd", 6).alias("smd"))


# ---- notes ----


@query(
    "note_search",
    """SELECT doc_id, substring(text, greatest(1, strpos(lower(text), 'license') - 60), 120) AS snippet, length(text) AS note_length
FROM documents WHERE lower(text) LIKE '%license%' ORDER BY doc_id LIMIT 100""",
)
def note_search(t: Tables) -> DataFrame:
    return catalog.search_notes(t.documents, "doc_id", "text", "license", limit=100, snippet=120)


@query("note_list", "SELECT source, doc_id, length(text) AS note_length, left(text, 100) AS preview FROM documents WHERE source = 'src3' ORDER BY doc_id LIMIT 20")
def note_list(t: Tables) -> DataFrame:
    return catalog.list_notes(t.documents, "source", "doc_id", "text", "src3")


@query(
    "note_get",
    """SELECT doc_id, left(text, 500) AS text, length(text) AS original_length, length(text) > 500 AS truncated FROM documents WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY source)""",
)
def note_get(t: Tables) -> DataFrame:
    wanted = t.documents.groupBy("source").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    return catalog.get_notes(t.documents, "doc_id", "text", wanted, most=500)


@query(
    "conversation_turns",
    """SELECT conv_id, count(*) AS turns, count(*) FILTER (WHERE role = 'user') AS user_turns, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1""",
)
def conversation_turns(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("user_turns"), F.sum(F.length("text")).alias("chars"))


# ---- time series ----

SECONDS = "CAST(epoch_us(ts) AS BIGINT)"


@query(
    "guarded_pivot_hourly",
    """SELECT user_id, date_trunc('hour', ts) AS hour,
  max(CASE WHEN event_type = 'view' AND value > 0 AND value <= 80 THEN value END) AS view_max,
  round(avg(CASE WHEN event_type = 'click' AND value > 5 AND value <= 90 THEN value END), 6) AS click_avg,
  min(CASE WHEN event_type IN ('purchase', 'signup') THEN value END) AS buy_min
FROM events WHERE event_type IN ('view', 'click', 'purchase', 'signup') GROUP BY 1, 2""",
)
def guarded_pivot_hourly(t: Tables) -> DataFrame:
    items = [pivot.Item("view_max", ("view",), 0, 80), pivot.Item("click_avg", ("click",), 5, 90, agg="avg"), pivot.Item("buy_min", ("purchase", "signup"), agg="min")]
    hourly = t.events.withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return pivot.guarded_pivot(hourly, ["user_id", "hour"], "event_type", "value", items).withColumn("click_avg", F.round("click_avg", 6))


@query(
    "anchored_first_day",
    """WITH a AS (SELECT user_id, min(ts) AS t0 FROM events GROUP BY 1)
SELECT a.user_id, t0, count(value) AS n, min(value) AS lo, max(value) AS hi FROM a LEFT JOIN events e
  ON a.user_id = e.user_id AND e.ts >= t0 - INTERVAL 6 HOUR AND e.ts <= t0 + INTERVAL 24 HOUR GROUP BY 1, 2""",
)
def anchored_first_day(t: Tables) -> DataFrame:
    anchors = t.events.groupBy("user_id").agg(F.min("ts").alias("t0"))
    aggs = [F.count("value").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")]
    return timeops.anchored_window(t.events.select("user_id", "ts", "value"), anchors, "user_id", "ts", "t0", "6 HOURS", "24 HOURS", aggs)


@query(
    "hourly_grid",
    """WITH s AS (SELECT user_id, min(ts) AS lo, max(ts) AS hi FROM events WHERE event_type = 'signup' GROUP BY 1),
g AS (SELECT user_id, CASE WHEN date_trunc('hour', lo) = lo THEN lo ELSE date_trunc('hour', lo) + INTERVAL 1 HOUR END AS f,
             unnest(generate_series(-24, CAST(ceil((epoch_us(hi) - epoch_us(lo)) / 3.6e9) AS INTEGER))) AS hr FROM s)
SELECT user_id, CAST(hr AS INTEGER) AS hr, f + hr * INTERVAL 1 HOUR AS endtime FROM g""",
)
def hourly_grid(t: Tables) -> DataFrame:
    stays = t.events.where("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    return timeops.hourly_grid(stays, "user_id", "lo", "hi")


@query(
    "rolling_6_12_24h",
    f"""SELECT event_id,
  round(sum(value) OVER (PARTITION BY user_id ORDER BY {SECONDS} RANGE BETWEEN 21600000000 PRECEDING AND CURRENT ROW), 6) AS s6,
  round(sum(value) OVER (PARTITION BY user_id ORDER BY {SECONDS} RANGE BETWEEN 43200000000 PRECEDING AND CURRENT ROW), 6) AS s12,
  round(sum(value) OVER (PARTITION BY user_id ORDER BY {SECONDS} RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW), 6) AS s24 FROM events""",
)
def rolling_6_12_24h(t: Tables) -> DataFrame:
    df = t.events.select("event_id", "user_id", "ts", "value")
    for hours in (6, 12, 24):
        df = timeops.rolling(df, "user_id", "ts", hours * 3600, {f"s{hours}": F.sum("value")})
    return df.select("event_id", *[F.round(c, 6).alias(c) for c in ("s6", "s12", "s24")])


@query("rolling_max_24rows", "SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS m FROM events")
def rolling_max_24rows(t: Tables) -> DataFrame:
    return timeops.rolling_rows(t.events, "user_id", ["ts", "event_id"], 24, {"m": F.max("value")}).select("event_id", "m")


@query(
    "lookback_min_48h_7d",
    f"""SELECT event_id,
  min(value) OVER (PARTITION BY user_id ORDER BY {SECONDS} RANGE BETWEEN 172800000000 PRECEDING AND 1 PRECEDING) AS low48,
  min(value) OVER (PARTITION BY user_id ORDER BY {SECONDS} RANGE BETWEEN 604800000000 PRECEDING AND 1 PRECEDING) AS low7 FROM events""",
)
def lookback_min_48h_7d(t: Tables) -> DataFrame:
    df = timeops.rolling(t.events, "user_id", "ts", 172_800, {"low48": F.min("value")}, include_current=False)
    return timeops.rolling(df, "user_id", "ts", 604_800, {"low7": F.min("value")}, include_current=False).select("event_id", "low48", "low7")


@query(
    "asof_within_2h",
    """WITH m AS (SELECT p.event_id, v.value AS value_before, v.ts AS at_time, row_number() OVER (PARTITION BY p.event_id ORDER BY v.ts DESC, v.event_id DESC) AS rn
  FROM events p LEFT JOIN events v ON v.user_id = p.user_id AND v.event_type = 'view' AND v.ts <= p.ts AND v.ts >= p.ts - INTERVAL 2 HOUR WHERE p.event_type = 'purchase')
SELECT event_id, value_before, at_time FROM m WHERE rn = 1""",
)
def asof_within_2h(t: Tables) -> DataFrame:
    bought = t.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    seen = t.events.where("event_type = 'view'").select("user_id", F.col("ts").alias("seen"), F.col("value").alias("value_before"), F.col("event_id").alias("seen_id"))
    found = timeops.asof_latest(bought, seen, "user_id", "ts", "seen", 7200, ["value_before"], "seen_id")
    return found.select("event_id", "value_before", F.col("seen_matched").alias("at_time"))


@query(
    "prev_row_carry_6h",
    """SELECT event_id, CASE WHEN lag(ts) OVER w > ts - INTERVAL 6 HOUR THEN lag(value) OVER w END AS prev FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def prev_row_carry_6h(t: Tables) -> DataFrame:
    return timeops.previous_within(t.events, "user_id", ["ts", "event_id"], "ts", "value", 6 * 3600, "prev").select("event_id", "prev")


@query(
    "sessionize_gap_status",
    """WITH l AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pt, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS ps FROM events),
n AS (SELECT *, CASE WHEN pt IS NULL OR epoch_us(ts) - epoch_us(ps) >= 50400000000 OR pt <> event_type THEN 1 ELSE 0 END AS new FROM l),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sess FROM n)
SELECT user_id, event_type, CAST(sess AS BIGINT) AS session, min(ts) AS starttime, max(ts) AS endtime, count(*) AS rows FROM s GROUP BY 1, 2, 3 HAVING count(*) >= 2""",
)
def sessionize_gap_status(t: Tables) -> DataFrame:
    return timeops.sessions(t.events, "user_id", ["ts", "event_id"], "ts", "event_type", 14 * 3600)


INTERVALS = """iv AS (SELECT user_id, event_type, ts AS s, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS e FROM events WHERE event_type IN ('error', 'signup'))"""


def _intervals(t: Tables) -> DataFrame:
    line = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return t.events.where("event_type in ('error', 'signup')").select("user_id", "event_type", F.col("ts").alias("s"), F.lead("ts").over(line).alias("e"))


@query(
    "timeline_segments",
    f"""WITH {INTERVALS}, p AS (SELECT user_id, s AS t FROM iv UNION SELECT user_id, e FROM iv),
g AS (SELECT user_id, t AS starttime, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS endtime FROM p WHERE t IS NOT NULL) SELECT * FROM g WHERE endtime IS NOT NULL""",
)
def timeline_segments(t: Tables) -> DataFrame:
    every = _intervals(t)
    return timeops.segments([every.where("event_type = 'error'"), every.where("event_type = 'signup'")], "user_id", "s", "e")


def _interval_sql(low: str, high: str) -> str:
    return f"""WITH {INTERVALS} SELECT p.event_id, count(iv.s) AS n FROM (SELECT * FROM events WHERE event_type IN ('purchase', 'error')) p
LEFT JOIN iv ON iv.user_id = p.user_id AND p.ts {low} iv.s AND p.ts {high} iv.e GROUP BY 1"""


def _interval(closed: str):
    def build(t: Tables) -> DataFrame:
        points = t.events.where("event_type in ('purchase', 'error')").select("event_id", "user_id", "ts")
        joined = timeops.interval_join(points, _intervals(t).drop("event_type"), "user_id", "ts", "s", "e", closed)
        return joined.groupBy("event_id").agg(F.count("s").alias("n"))

    return build


for _closed, _low, _high in (("both", ">=", "<="), ("left", ">=", "<"), ("right", ">", "<=")):
    query(f"interval_{_closed}", _interval_sql(_low, _high))(_interval(_closed))


@query(
    "event_pair_72_24",
    """SELECT p.event_id, e.event_id AS error_id FROM events p JOIN events e ON e.user_id = p.user_id AND e.event_type = 'error'
  AND e.ts >= p.ts - INTERVAL 72 HOUR AND e.ts <= p.ts + INTERVAL 24 HOUR WHERE p.event_type = 'purchase'""",
)
def event_pair_72_24(t: Tables) -> DataFrame:
    bought = t.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    failed = t.events.where("event_type = 'error'").select("user_id", F.col("ts").alias("failed"), F.col("event_id").alias("error_id"))
    return timeops.event_pairs(bought, failed, "user_id", "ts", "failed", "72 HOURS", "24 HOURS").select("event_id", "error_id")


@query(
    "full_outer_merge",
    """WITH v AS (SELECT user_id, CAST(ts AS DATE) AS d, count(*) AS views FROM events WHERE event_type = 'view' GROUP BY 1, 2),
c AS (SELECT user_id, CAST(ts AS DATE) AS d, count(*) AS clicks FROM events WHERE event_type = 'click' GROUP BY 1, 2)
SELECT coalesce(v.user_id, c.user_id) AS user_id, CAST(coalesce(v.d, c.d) AS VARCHAR) AS d, views, clicks FROM v FULL JOIN c ON v.user_id = c.user_id AND v.d = c.d""",
)
def full_outer_merge(t: Tables) -> DataFrame:
    daily = lambda kind, name: t.events.where(f"event_type = '{kind}'").groupBy("user_id", F.to_date("ts").cast("string").alias("d")).agg(F.count("*").alias(name))
    return daily("view", "views").join(daily("click", "clicks"), ["user_id", "d"], "full")


@query(
    "segment_seq",
    """SELECT o_orderkey, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS INTEGER) AS seq,
  dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) = 1 AS first_order FROM orders""",
)
def segment_seq(t: Tables) -> DataFrame:
    rank = F.dense_rank().over(Window.partitionBy("o_custkey").orderBy("o_orderdate"))
    return t.orders.select("o_orderkey", rank.alias("seq"), (rank == 1).alias("first_order"))


@query(
    "lead_close_interval",
    """SELECT o_orderkey, o_orderdate, coalesce(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), o_orderdate + INTERVAL 2 HOUR) AS endtime FROM orders""",
)
def lead_close_interval(t: Tables) -> DataFrame:
    closed = timeops.close_with_lead(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderdate", F.col("o_orderdate") + F.expr("INTERVAL 2 HOURS"))
    return closed.select("o_orderkey", "o_orderdate", "endtime")


@query(
    "transitions",
    """WITH l AS (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) SELECT prev, event_type, count(*) AS n FROM l WHERE prev IS NOT NULL GROUP BY 1, 2""",
)
def transitions(t: Tables) -> DataFrame:
    line = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("event_type", F.lag("event_type").over(line).alias("prev")).where("prev is not null").groupBy("prev", "event_type").agg(F.count("*").alias("n"))


@query(
    "time_weighted_avg",
    """WITH l AS (SELECT user_id, value, (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts)) / 6e7 AS m FROM events)
SELECT user_id, round(sum(value * m) / sum(m), 6) AS twa FROM l WHERE m > 0 AND value IS NOT NULL GROUP BY 1""",
)
def time_weighted_avg(t: Tables) -> DataFrame:
    line = Window.partitionBy("user_id").orderBy("ts", "event_id")
    spans = t.events.select("user_id", "value", (F.timestamp_diff("MICROSECOND", F.col("ts"), F.lead("ts").over(line)) / 6e7).alias("m"))
    return spans.where("m > 0 and value is not null").groupBy("user_id").agg(F.round(F.sum(F.col("value") * F.col("m")) / F.sum("m"), 6).alias("twa"))


# ---- codes and scores ----

GROUPS = {"promo": ("PROMO",), "metal": ("STANDARD", "SMALL"), "large": ("LARGE", "ECONOMY", "MEDIUM")}
FLAGS_SQL = """f AS (SELECT l_orderkey, max(CASE WHEN p_type LIKE 'PROMO%' THEN 1 ELSE 0 END) AS promo, max(CASE WHEN p_type LIKE 'STANDARD%' OR p_type LIKE 'SMALL%' THEN 1 ELSE 0 END) AS metal,
  max(CASE WHEN p_type LIKE 'LARGE%' OR p_type LIKE 'ECONOMY%' OR p_type LIKE 'MEDIUM%' THEN 1 ELSE 0 END) AS large FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)"""


def _flags(t: Tables) -> DataFrame:
    coded = t.lineitem.select("l_orderkey", "l_partkey").join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
    return codes.prefix_flags(coded, "l_orderkey", "p_type", GROUPS)


@query("prefix_flags", f"WITH {FLAGS_SQL} SELECT * FROM f")
def prefix_flags(t: Tables) -> DataFrame:
    return _flags(t)


@query("weighted_index", f"WITH {FLAGS_SQL} SELECT l_orderkey, promo * 3 + metal * 2 + CASE WHEN promo = 1 THEN 0 ELSE large END AS score FROM f")
def weighted_index(t: Tables) -> DataFrame:
    flags = _flags(t)
    return flags.select("l_orderkey", codes.weighted_index(flags, {"promo": 3, "metal": 2, "large": 1}, [("promo", "large")]).alias("score"))


@query(
    "prefix_lookup_score",
    """WITH k(prefix, w) AS (VALUES ('PRO', 1), ('PROMO', 4), ('STA', 2), ('ECONO', 4), ('SMA', 1)),
c AS (SELECT DISTINCT l_orderkey, p_type FROM lineitem JOIN part ON l_partkey = p_partkey),
m AS (SELECT l_orderkey, w, row_number() OVER (PARTITION BY l_orderkey, p_type ORDER BY length(prefix) DESC) AS rn FROM c JOIN k ON p_type LIKE prefix || '%')
SELECT l_orderkey, CAST(sum(w) AS BIGINT) AS plain, CAST(sum(DISTINCT w) AS BIGINT) AS by_weight FROM m WHERE rn = 1 GROUP BY 1""",
)
def prefix_lookup_score(t: Tables) -> DataFrame:
    lookup = t.spark.createDataFrame([("PRO", 1), ("PROMO", 4), ("STA", 2), ("ECONO", 4), ("SMA", 1)], "prefix string, w int")
    coded = t.lineitem.select("l_orderkey", "l_partkey").join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
    types = t.part.select("p_type").distinct()
    weights = codes.longest_prefix(types, lookup, "p_type", "prefix", (3, 4, 5), ["w"], [])
    best = coded.select("l_orderkey", "p_type").distinct().join(weights, "p_type")
    return best.groupBy("l_orderkey").agg(F.sum("w").alias("plain"), F.sum_distinct("w").alias("by_weight"))


@query(
    "threshold_score",
    """WITH a AS (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS hi, min(o_totalprice) AS lo FROM orders GROUP BY 1),
s AS (SELECT o_custkey, CASE WHEN n >= 15 THEN 3 WHEN n >= 10 THEN 2 WHEN n >= 5 THEN 1 ELSE 0 END AS n_points,
 CASE WHEN abs(hi - 150000) >= abs(lo - 150000) THEN hi ELSE lo END AS worst FROM a)
SELECT o_custkey, n_points, worst, n_points + CASE WHEN worst < 5000 THEN 4 WHEN worst > 300000 THEN 2 ELSE 0 END AS score FROM s""",
)
def threshold_score(t: Tables) -> DataFrame:
    per = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("hi"), F.min("o_totalprice").alias("lo"))
    points = score.banded(F.col("n"), [score.Band(">=", 15, 3), score.Band(">=", 10, 2), score.Band(">=", 5, 1)])
    out = per.select("o_custkey", points.cast("int").alias("n_points"), score.worst_from_normal(F.col("lo"), F.col("hi"), 150_000).alias("worst"))
    return out.withColumn("score", score.total(F.col("n_points"), score.banded(F.col("worst"), [score.Band("<", 5000, 4), score.Band(">", 300_000, 2)])).cast("int"))


@query(
    "logistic_prob",
    """SELECT o_custkey, round(1 / (1 + exp(-(-4.4360 + 0.04726 * count(*)))), 9) AS prob, round(ln(1 + max(o_totalprice)), 9) AS log_top FROM orders GROUP BY 1""",
)
def logistic_prob(t: Tables) -> DataFrame:
    per = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"))
    return per.select("o_custkey", F.round(score.logistic(F.lit(-4.4360) + F.lit(0.04726) * F.col("n")), 9).alias("prob"), F.round(F.ln(1 + F.col("top")), 9).alias("log_top"))


@query("drug_like_class", "SELECT p_partkey, lower(p_name) LIKE '%green%' OR lower(p_name) LIKE '%blue%' OR lower(p_name) LIKE '%part%' AS hit FROM part")
def drug_like_class(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", compat.matches_any(F.col("p_name"), ("green", "blue", "part")).alias("hit"))


@query("listagg_distinct", "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY 1")
def listagg_distinct(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ", ").alias("priorities"))


@query("ordered_codes_agg", "SELECT l_orderkey, string_agg(l_returnflag, ',' ORDER BY l_linenumber, l_returnflag) AS flags FROM lineitem GROUP BY 1")
def ordered_codes_agg(t: Tables) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag")))
    return t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.transform(ordered, lambda x: x["l_returnflag"]), ",").alias("flags"))


@query(
    "calibration_deciles",
    """SELECT CAST(floor(l_quantity / 10) * 10 AS BIGINT) AS band, count(*) AS n, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS observed, round(sum(l_discount * 5), 6) AS expected,
  round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END), 6) AS observed_rate, round(avg(l_discount * 5), 6) AS expected_rate FROM lineitem GROUP BY 1""",
)
def calibration_deciles(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_quantity", F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("dead"), (F.col("l_discount") * 5).alias("risk"))
    rates = cohort.calibration(lines, "l_quantity", "dead", "risk")
    return rates.select("band", "n", "observed", *[F.round(c, 6).alias(c) for c in ("expected", "observed_rate", "expected_rate")])


@query("smr", "SELECT l_linestatus, round(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) / sum(l_discount * 5), 6) AS smr FROM lineitem GROUP BY 1")
def smr(t: Tables) -> DataFrame:
    observed = F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0))
    return t.lineitem.groupBy("l_linestatus").agg(F.round(compat.divide(observed, F.sum(F.col("l_discount") * 5)), 6).alias("smr"))


# ---- comparison and reshaping ----


@query(
    "match_rate",
    """WITH c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 13 <> 0),
j AS (SELECT o.o_totalprice AS a, c.o_totalprice AS b, o.o_orderstatus AS x, c.o_orderstatus AS y, c.o_orderkey IS NOT NULL AS p FROM orders o LEFT JOIN c ON o.o_orderkey = c.o_orderkey)
SELECT 'o_totalprice' AS column_name, count(*) FILTER (WHERE p AND abs(a - b) <= 0.5) AS n_matched, count(*) AS n_total, count(*) FILTER (WHERE p AND abs(a - b) <= 0.5) / count(*) AS match_rate FROM j
UNION ALL SELECT 'o_orderstatus', count(*) FILTER (WHERE p AND x = y), count(*), count(*) FILTER (WHERE p AND x = y) / count(*) FROM j""",
)
def match_rate(t: Tables) -> DataFrame:
    changed = t.orders.where("o_orderkey % 13 != 0").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 10 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")).alias("o_orderstatus"),
    )
    truth = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    return compare.match_rates(changed, truth, ["o_orderkey"], ["o_totalprice", "o_orderstatus"], {"o_totalprice": 0.5})


@query(
    "merge_typed_nulls",
    """SELECT 'event' AS kind, event_id AS id, ts AS at, value, NULL AS status FROM events UNION ALL SELECT 'order', o_orderkey, o_orderdate, NULL, o_orderstatus FROM orders""",
)
def merge_typed_nulls(t: Tables) -> DataFrame:
    seen = t.events.select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("ts").alias("at"), "value")
    ordered = t.orders.select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"), F.col("o_orderstatus").alias("status"))
    return seen.unionByName(ordered, allowMissingColumns=True)


@query(
    "denormalise",
    """SELECT c_custkey, n_name, r_name, o_orderkey, o_orderstatus FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN orders ON o_custkey = c_custkey""",
)
def denormalise(t: Tables) -> DataFrame:
    people = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return people.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "n_name", "r_name", "o_orderkey", "o_orderstatus")


@query("union_distinct", "SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def union_distinct(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_custkey").alias("k")).union(t.customer.where("c_acctbal < 0").select("c_custkey")).distinct()


@query(
    "decorrelated_minimum",
    """SELECT o_orderkey, (SELECT min(l_shipdate) FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 30) AS first_ship FROM orders""",
)
def decorrelated_minimum(t: Tables) -> DataFrame:
    least = t.lineitem.where("l_quantity > 30").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("first_ship"))
    return t.orders.select("o_orderkey").join(least, "o_orderkey", "left")


@query(
    "category_bias",
    """WITH r AS (SELECT coalesce(c_acctbal > 0, false) AS k, v, CASE v WHEN 'c_mktsegment' THEN c_mktsegment ELSE CAST(c_nationkey AS VARCHAR) END AS c FROM customer, (VALUES ('c_mktsegment'), ('c_nationkey')) AS n(v)),
p AS (SELECT v, c, count(*) FILTER (WHERE k) AS a, count(*) FILTER (WHERE NOT k) AS b FROM r GROUP BY 1, 2), s AS (SELECT *, a / sum(a) OVER (PARTITION BY v) AS x, b / sum(b) OVER (PARTITION BY v) AS y FROM p)
SELECT v AS variable_name, c AS category, a AS n_kept, b AS n_excluded, round(x, 9) AS share_kept, round(y, 9) AS share_excluded, round((x - y) / sqrt((x * (1 - x) + y * (1 - y)) / 2), 9) AS smd FROM s""",
)
def category_bias(t: Tables) -> DataFrame:
    found = cohort.category_bias(t.customer, F.col("c_acctbal") > 0, ["c_mktsegment", "c_nationkey"])
    return found.select("variable_name", "category", "n_kept", "n_excluded", *[F.round(c, 9).alias(c) for c in ("share_kept", "share_excluded", "smd")])
