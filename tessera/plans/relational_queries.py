"""Queries of the small relational operators over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import compat
from tessera.operators import codes, cohort, compare, relational, restructure, timeops
from tessera.plans.base import Tables, registrar
from tessera.plans.clinical_base import TWIN_SLOTS, base_sql, base_tables
from tessera.quality import notes

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
query = registrar(QUERIES, ORACLES)


@query("surrogate_keys", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate NULLS FIRST, o_orderkey) AS row_key FROM orders")
def surrogate_keys(t: Tables) -> DataFrame:
    return relational.surrogate_keys(t.orders.select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "row_key")


@query("hash_sample", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('7:' || o_orderkey), o_orderkey LIMIT 30")
def hash_sample(t: Tables) -> DataFrame:
    return relational.hash_sample(t.orders, ["o_orderkey"], 30, seed=7).select("o_orderkey", "o_totalprice")


@query("top_values", "SELECT p_type, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY n DESC, p_type LIMIT 10")
def top_values(t: Tables) -> DataFrame:
    return relational.top_values(t.lineitem.select(F.col("l_partkey").alias("p_partkey")).join(t.part.select("p_partkey", "p_type"), "p_partkey"), "p_type", 10)


@query(
    "first_pivot",
    """SELECT o_custkey, min_by(o_totalprice, (o_orderdate, o_orderkey)) FILTER (WHERE o_orderstatus = 'F') AS F, min_by(o_totalprice, (o_orderdate, o_orderkey)) FILTER (WHERE o_orderstatus = 'O') AS O FROM orders GROUP BY 1""",
)
def first_pivot(t: Tables) -> DataFrame:
    rows = t.orders.withColumn("place", F.struct("o_orderdate", "o_orderkey"))
    return relational.first_pivot(rows, "o_custkey", "o_orderstatus", "o_totalprice", ["F", "O"], "place")


@query(
    "presence_pivot",
    """SELECT user_id, CASE WHEN bool_or(event_type = 'error') THEN 1 ELSE 0 END AS error, CASE WHEN bool_or(event_type = 'purchase') THEN 1 ELSE 0 END AS purchase FROM events GROUP BY 1""",
)
def presence_pivot(t: Tables) -> DataFrame:
    return relational.presence_pivot(t.events, "user_id", "event_type", ["error", "purchase"])


@query("drop_repeats", "SELECT DISTINCT ON (o_custkey, o_orderstatus) o_custkey, o_orderstatus, o_orderkey FROM orders ORDER BY o_custkey, o_orderstatus, o_orderdate, o_orderkey")
def drop_repeats(t: Tables) -> DataFrame:
    return relational.drop_repeats(t.orders, ["o_custkey", "o_orderstatus"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderstatus", "o_orderkey")


@query("any_value_per_group", "SELECT n_regionkey, any_value(r_name) AS r_name, count(*) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def any_value_per_group(t: Tables) -> DataFrame:
    joined = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("n_regionkey").agg(F.any_value("r_name", F.lit(True)).alias("r_name"), F.count("*").alias("nations"))


@query("median_per_group", "SELECT o_orderpriority, median(o_totalprice) AS middle FROM orders GROUP BY 1")
def median_per_group(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").agg(F.median("o_totalprice").alias("middle"))


@query("weighted_mean", "SELECT round(sum(l_discount * l_quantity) / sum(l_quantity), 9) AS weighted_mean FROM lineitem")
def weighted_mean(t: Tables) -> DataFrame:
    return relational.weighted_mean(t.lineitem, "l_discount", "l_quantity").select(F.round("weighted_mean", 9).alias("weighted_mean"))


@query(
    "whole_units_between",
    """SELECT event_id, date_diff('hour', lag(ts) OVER w, ts) AS hours, date_diff('day', lag(ts) OVER w, ts) AS days FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def whole_units_between(t: Tables) -> DataFrame:
    from pyspark.sql.window import Window

    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = t.events.select("event_id", "ts", before.alias("before"))
    return rows.select("event_id", *[relational.boundaries_between(u, F.col("before"), F.col("ts")).alias(f"{u.lower()}s") for u in ("HOUR", "DAY")])


@query("replace_first", "SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '#') AS name FROM part")
def replace_first(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", relational.replace_first(F.col("p_name"), "[aeiou]", "#").alias("name"))


@query("one_character_wildcards", "SELECT p_partkey FROM part WHERE p_type LIKE '_ROMO%' OR p_brand LIKE 'Brand#_3'")
def one_character_wildcards(t: Tables) -> DataFrame:
    return t.part.where(F.col("p_type").like("_ROMO%") | F.col("p_brand").like("Brand#_3")).select("p_partkey")


@query("not_like_not_in", "SELECT event_id FROM (SELECT event_id, nullif(event_type, 'error') AS e FROM events) WHERE e NOT LIKE '%up%' AND e NOT IN ('view')")
def not_like_not_in(t: Tables) -> DataFrame:
    kind = F.nullif(F.col("event_type"), F.lit("error"))
    return t.events.where(~kind.like("%up%") & ~kind.isin("view")).select("event_id")


@query("nulls_first_rank", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type <> 'click' THEN value END NULLS FIRST, event_id) AS nth FROM events")
def nulls_first_rank(t: Tables) -> DataFrame:
    from pyspark.sql.window import Window

    rows = t.events.select("event_id", "user_id", F.when(F.col("event_type") != "click", F.col("value")).alias("v"))
    return rows.select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("v").asc_nulls_first(), "event_id")).alias("nth"))


@query(
    "lookup_groups",
    """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'soon' WHEN '2-HIGH' THEN 'soon' WHEN '5-LOW' THEN 'late' ELSE 'other' END AS class FROM orders""",
)
def lookup_groups(t: Tables) -> DataFrame:
    return relational.in_groups(t.orders, "o_orderpriority", {"soon": ["1-URGENT", "2-HIGH"], "late": ["5-LOW"]}, "class", "other").select("o_orderkey", "class")


HISTORY_SQL = """h AS (SELECT a.o_orderkey, b.o_orderkey AS source FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderdate < a.o_orderdate AND b.o_orderdate >= a.o_orderdate - INTERVAL 2 YEAR AND b.o_orderpriority = '1-URGENT'
  UNION ALL SELECT o_orderkey, o_orderkey FROM orders)"""


@query("qualifying_history", f"WITH {HISTORY_SQL} SELECT * FROM h")
def qualifying_history(t: Tables) -> DataFrame:
    return relational.qualifying_history(t.orders, "o_custkey", "o_orderkey", "o_orderdate", F.col("o_orderpriority") == "1-URGENT")


@query(
    "frailty_with_history",
    f"""WITH {HISTORY_SQL}, k(prefix, w) AS (VALUES ('PRO', 1.5), ('PROMO', 4.0), ('STA', 2.5), ('ECONO', 4.0), ('SMA', 1.5)), c AS (SELECT DISTINCT l_orderkey, p_type FROM lineitem JOIN part ON l_partkey = p_partkey),
m AS (SELECT l_orderkey, w, row_number() OVER (PARTITION BY l_orderkey, p_type ORDER BY length(prefix) DESC) AS rn FROM c JOIN k ON p_type LIKE prefix || '%'),
s AS (SELECT h.o_orderkey, sum(DISTINCT w) AS score FROM h JOIN m ON m.l_orderkey = source AND rn = 1 GROUP BY 1)
SELECT o_orderkey, CAST(coalesce(score, 0) AS DOUBLE) AS score, CASE WHEN coalesce(score, 0) < 5 THEN 'low' WHEN score < 15 THEN 'intermediate' ELSE 'high' END AS band FROM orders LEFT JOIN s USING (o_orderkey)""",
)
def frailty_with_history(t: Tables) -> DataFrame:
    lookup = t.spark.createDataFrame([("PRO", 1.5), ("PROMO", 4.0), ("STA", 2.5), ("ECONO", 4.0), ("SMA", 1.5)], "prefix string, w double")
    types = codes.longest_prefix(t.part.select("p_type").distinct(), lookup, "p_type", "prefix", (3, 4, 5), ["w"], [])
    parts = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_type").join(F.broadcast(types), "p_type").select("l_partkey", "w")
    coded = t.lineitem.select(F.col("l_orderkey").alias("source"), "l_partkey").join(parts, "l_partkey").select("source", "w").distinct()  # the sum is over distinct weights
    history = relational.qualifying_history(t.orders, "o_custkey", "o_orderkey", "o_orderdate", F.col("o_orderpriority") == "1-URGENT")
    scores = history.join(coded, "source").select("o_orderkey", "w").distinct().groupBy("o_orderkey").agg(F.sum("w").alias("s"))
    score = F.coalesce("s", F.lit(0.0))
    band = F.when(score < 5, "low").when(score < 15, "intermediate").otherwise("high")
    return t.orders.select("o_orderkey").join(scores, "o_orderkey", "left").select("o_orderkey", score.alias("score"), band.alias("band"))


@query(
    "exclusion_flow",
    """WITH b AS (SELECT c_acctbal AS x, CAST(c_nationkey AS DOUBLE) AS y, c_acctbal > 0 AS s1, c_mktsegment = 'BUILDING' AS s2 FROM customer),
r AS (SELECT 1 AS step, 'solvent' AS label, s1 AS k, x, y FROM b UNION ALL SELECT 2, 'building', s2, x, y FROM b WHERE s1),
u AS (SELECT step, label, k, 'c_acctbal' AS variable_name, x AS v FROM r UNION ALL SELECT step, label, k, 'c_nationkey', y FROM r),
g AS (SELECT step, label, variable_name, count(*) AS n_before, count(*) FILTER (WHERE k) AS n_kept, count(*) FILTER (WHERE v IS NULL) AS n_missing,
  (avg(v) FILTER (WHERE k) - avg(v) FILTER (WHERE NOT k)) / sqrt((var_samp(v) FILTER (WHERE k) + var_samp(v) FILTER (WHERE NOT k)) / 2) AS smd FROM u GROUP BY 1, 2, 3)
SELECT step, label, variable_name, n_before, n_kept, n_before - n_kept AS n_excluded, n_missing, round(smd, 6) AS smd, CASE WHEN abs(smd) > 0.3 THEN 'High' WHEN abs(smd) > 0.2 THEN 'Flagged' ELSE 'Low' END AS bias FROM g""",
)
def exclusion_flow(t: Tables) -> DataFrame:
    steps = [("solvent", F.col("c_acctbal") > 0), ("building", F.col("c_mktsegment") == "BUILDING")]
    return cohort.exclusion_flow(t.customer, steps, ["c_acctbal", "c_nationkey"]).withColumn("smd", F.round("smd", 6))


@query(
    "interval_overlap",
    """WITH i AS (SELECT event_id, user_id, ts AS s, ts + INTERVAL 3 HOUR AS e FROM events WHERE event_type IN ('error', 'signup'))
SELECT a.event_id, count(b.event_id) AS n FROM i a LEFT JOIN i b ON a.user_id = b.user_id AND a.event_id <> b.event_id AND a.s <= b.e AND b.s <= a.e GROUP BY 1""",
)
def interval_overlap(t: Tables) -> DataFrame:
    spans = t.events.where("event_type in ('error', 'signup')").select("event_id", "user_id", F.col("ts").alias("s"), (F.col("ts") + F.expr("interval 3 hour")).alias("e"))
    a, b = spans.alias("a"), spans.alias("b")
    meet = (F.col("a.user_id") == F.col("b.user_id")) & (F.col("a.event_id") != F.col("b.event_id")) & timeops.overlaps(F.col("a.s"), F.col("a.e"), F.col("b.s"), F.col("b.e"))
    return a.join(b, meet, "left").groupBy(F.col("a.event_id").alias("event_id")).agg(F.count("b.event_id").alias("n"))


@query("prefix_between", "SELECT p_partkey, left(p_type, 3) BETWEEN 'MED' AND 'SMA' AS inside FROM part")
def prefix_between(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", codes.prefix_between(F.col("p_type"), 3, "MED", "SMA").alias("inside"))


@query(
    "value_kinds",
    """WITH v AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN CAST(o_custkey AS VARCHAR) WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE o_orderpriority END AS v FROM orders)
SELECT o_orderkey, CASE WHEN v = '' THEN '' WHEN v LIKE '____-%' AND TRY_CAST(v AS TIMESTAMP) IS NOT NULL THEN 'timestamp' WHEN TRY_CAST(v AS DOUBLE) IS NOT NULL THEN 'numeric' ELSE 'string' END AS kind FROM v""",
)
def value_kinds(t: Tables) -> DataFrame:
    four = F.expr("CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN CAST(o_custkey AS STRING) WHEN 2 THEN date_format(o_orderdate, 'yyyy-MM-dd') ELSE o_orderpriority END")
    return t.orders.select("o_orderkey", compat.value_kind(four).alias("kind"))


NOTE_RULES = [("license", "licen[sc]e|copyright"), ("contact", "@[a-z0-9]"), ("number", "[0-9]{8}")]


@query(
    "note_classes",
    """SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)licen[sc]e|copyright') THEN 'license' WHEN regexp_matches(text, '(?i)@[a-z0-9]') THEN 'contact' WHEN regexp_matches(text, '[0-9]{8}') THEN 'number' ELSE 'other' END AS class FROM documents""",
)
def note_classes(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", notes.classify(F.col("text"), NOTE_RULES, "other").alias("class"))


@query(
    "identifier_labels",
    """SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[a-z0-9.]+@[a-z0-9]+(\\.[a-z0-9]+)+', '<mail>', 'g'), '\\b[0-9]{16}\\b', '<card>', 'g')) AS digest FROM documents""",
)
def identifier_labels(t: Tables) -> DataFrame:
    patterns = {"mail": r"[a-z0-9.]+@[a-z0-9]+(?:\.[a-z0-9]+)+", "card": r"\b[0-9]{16}\b"}
    return notes.label_identifiers(t.documents.select("doc_id", "text"), "text", patterns).select("doc_id", F.md5("labelled").alias("digest"))


@query(
    "twelve_leads",
    """WITH e AS (SELECT vec_id, embedding[1:32]::DOUBLE[] AS i, embedding[33:64]::DOUBLE[] AS j FROM embeddings)
SELECT vec_id, round(list_sum(list_transform(range(1, 33), lambda k: j[k] - i[k])), 6) AS iii, round(list_sum(list_transform(range(1, 33), lambda k: -(i[k] + j[k]) / 2)), 6) AS avr,
  round(list_sum(list_transform(range(1, 33), lambda k: i[k] - j[k] / 2)), 6) AS avl, round(list_sum(list_transform(range(1, 33), lambda k: j[k] - i[k] / 2)), 6) AS avf FROM e""",
)
def twelve_leads(t: Tables) -> DataFrame:
    leads = relational.twelve_leads(t.embeddings.select("vec_id", F.slice("embedding", 1, 32).alias("i"), F.slice("embedding", 33, 32).alias("ii")), "i", "ii")
    return leads.select("vec_id", *[F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 6).alias(c) for c in ("iii", "avr", "avl", "avf")])


@query("int16_samples", "SELECT o_orderkey, CAST(ascii(left(o_orderpriority, 1)) + 256 * ascii(substring(o_orderpriority, 2, 1)) AS INTEGER) AS first FROM orders")
def int16_samples(t: Tables) -> DataFrame:
    coded = F.base64(F.encode(F.left("o_orderpriority", F.lit(4)), "UTF-8"))
    return t.orders.select("o_orderkey", relational.int16_samples(coded)[0].alias("first"))


@query(
    "reward",
    """WITH c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS p, o_orderstatus AS s FROM orders WHERE o_orderkey % 13 <> 0),
j AS (SELECT count(*) AS n, count(*) FILTER (WHERE abs(p - o_totalprice) <= 0.5) AS a, count(*) FILTER (WHERE s = o_orderstatus) AS b FROM orders o LEFT JOIN c ON c.o_orderkey = o.o_orderkey) SELECT round((a / n + b / n + 0) / 3, 9) AS reward FROM j""",
)
def reward(t: Tables) -> DataFrame:
    """A candidate with some prices off, some keys missing and one column lacking."""
    changed = t.orders.where("o_orderkey % 13 != 0").select(F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 10 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"), "o_orderstatus")
    rates = compare.match_rates(changed, t.orders, ["o_orderkey"], ["o_totalprice", "o_orderstatus", "o_orderdate"], {"o_totalprice": 0.5})
    return compare.reward(rates).select(F.round("reward", 9).alias("reward"))


_COHORT_BASE = ("admissions", "icustays", "patients", "diagnoses_icd")
#: Cohorts by name, and what an admission of each must meet, written out for the twin.
COHORTS = {
    "any_code": (cohort.AdmissionCriteria(age_min=30, age_max=80, codes=("E11", "428"), has_stay=False), "anchor_age BETWEEN 30 AND 80 AND NOT s AND EXISTS (SELECT 1 FROM diagnoses_icd d WHERE d.hadm_id = x.hadm_id AND (icd_code LIKE 'E11%' OR icd_code LIKE '428%'))"),
    "every_code": (
        cohort.AdmissionCriteria(gender="F", codes=("I", "E"), match_all=True, died=False),
        "gender = 'F' AND hospital_expire_flag = 0 AND EXISTS (SELECT 1 FROM diagnoses_icd d WHERE d.hadm_id = x.hadm_id AND icd_code LIKE 'I%') AND EXISTS (SELECT 1 FROM diagnoses_icd d WHERE d.hadm_id = x.hadm_id AND icd_code LIKE 'E%')",
    ),
    "died_in_care": (cohort.AdmissionCriteria(has_stay=True, died=True), "s AND hospital_expire_flag = 1"),
}


def _cohorts_twin() -> str:
    base = base_sql(TWIN_SLOTS)
    ctes = ", ".join(f"{n} AS MATERIALIZED ({base[n]})" for n in _COHORT_BASE)
    rows = " UNION ALL ".join(f"SELECT '{n}' AS cohort, subject_id, hadm_id FROM x WHERE {test}" for n, (_, test) in COHORTS.items())
    return f"""WITH {ctes}, x AS (SELECT a.subject_id, a.hadm_id, a.hospital_expire_flag, gender, anchor_age, EXISTS (SELECT 1 FROM icustays i WHERE i.hadm_id = a.hadm_id) AS s FROM admissions a JOIN patients p ON p.subject_id = a.subject_id), c AS ({rows})
SELECT n.cohort, count(DISTINCT c.subject_id) AS patient_count, count(DISTINCT c.hadm_id) AS admission_count, count(DISTINCT stay_id) AS icu_stay_count
FROM (VALUES {", ".join(f"('{n}')" for n in COHORTS)}) AS n(cohort) LEFT JOIN c ON c.cohort = n.cohort LEFT JOIN icustays i ON i.hadm_id = c.hadm_id GROUP BY 1"""


@query("admission_cohorts", _cohorts_twin())
def admission_cohorts(t: Tables) -> DataFrame:
    tables = base_tables(t.spark, _COHORT_BASE, lambda x: getattr(t, x))
    out = None
    for name, (criteria, _) in COHORTS.items():
        chosen = cohort.select_admissions(tables["patients"], tables["admissions"], tables["diagnoses_icd"], tables["icustays"], criteria)
        found = cohort.admission_counts(chosen, tables["icustays"]).select(F.lit(name).alias("cohort"), "*")
        out = found if out is None else out.unionByName(found)
    return out


#: Golden texts over the bound base tables, in words that both engines read.
GOLDEN = {
    "charts_of_stays": """SELECT i.stay_id, CASE WHEN p.gender = 'F' THEN 1 ELSE 0 END AS female, count(*) AS n, max(c.valuenum) AS valuenum, min(c.charttime) AS charttime
FROM icustays i JOIN admissions a ON a.hadm_id = i.hadm_id JOIN patients p ON p.subject_id = i.subject_id JOIN chartevents c ON c.stay_id = i.stay_id WHERE c.itemid = 220045 AND c.charttime >= i.intime GROUP BY i.stay_id, p.gender""",
    "balance": """WITH given AS (SELECT stay_id, count(*) AS n FROM inputevents GROUP BY stay_id), lost AS (SELECT stay_id, sum(value) AS value FROM outputevents GROUP BY stay_id)
SELECT i.stay_id, 0 AS female, coalesce(given.n, 0) AS n, lost.value AS valuenum, i.intime AS charttime FROM icustays i LEFT JOIN given ON given.stay_id = i.stay_id LEFT JOIN lost ON lost.stay_id = i.stay_id""",
}
_GOLDEN_TABLES = ("patients", "admissions", "icustays", "chartevents", "labevents", "inputevents", "outputevents")
_OTHER_NAMES = {"subject_id": "k1", "hadm_id": "k2", "stay_id": "k3", "itemid": "k4", "gender": "c1", "valuenum": "c2", "value": "c3", "charttime": "t1", "intime": "t2"}


def _three_times() -> str:
    base = base_sql(TWIN_SLOTS)
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({base[name]})" for name in ("admissions", "icustays", *[t for t in _GOLDEN_TABLES if t not in ("admissions", "icustays")]))
    asked = " UNION ALL ".join(f"SELECT '{name}' AS question, g.* FROM ({text}) g" for name, text in GOLDEN.items())
    return f"WITH {ctes}, asked AS ({asked}) SELECT s.schema_name, asked.* FROM asked, (VALUES ('given'), ('renamed'), ('merged')) AS s(schema_name)"


@query("three_schemas", _three_times())
def three_schemas(t: Tables) -> DataFrame:
    """Golden texts asked of the base tables as they are, under other names, and through the views of merged tables."""
    base = base_tables(t.spark, _GOLDEN_TABLES, lambda x: getattr(t, x))
    tables = {name: base[name] for name in _GOLDEN_TABLES}
    other = compare.renamed(tables, {name: f"x{i}" for i, name in enumerate(tables)}, _OTHER_NAMES)
    schemas = {"given": (tables, {}), "renamed": (dict(zip(tables, other.values(), strict=True)), _OTHER_NAMES), "merged": (restructure.restructured(tables)[1], {})}
    out = None
    for schema, (held, names) in schemas.items():
        views = {name: f"_tessera_{schema}_{name}" for name in held}
        for name, view in views.items():
            held[name].createOrReplaceTempView(view)
        for question, text in GOLDEN.items():
            found = restructure.names_back(t.spark.sql(restructure.rewrite_sql(t.spark, text, views, names)), names)
            found = found.select(F.lit(schema).alias("schema_name"), F.lit(question).alias("question"), *found.columns)
            out = found if out is None else out.unionByName(found)
        for view in views.values():
            t.spark.catalog.dropTempView(view)
    return out


@query("equivalent_schemas", "SELECT true AS renamed_equal, true AS restructured_equal, false AS changed_equal")
def equivalent_schemas(t: Tables) -> DataFrame:
    """One question asked of three schemas: the given one, one with other names, and one with customers and orders as one table; and a wrong answer."""

    def ask(people: DataFrame, orders: DataFrame, key: str, segment: str) -> DataFrame:
        return people.select(F.col(key).alias("k"), segment).join(orders.select(F.col(key).alias("k"), "o_totalprice"), "k").groupBy(segment).agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"))

    orders = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    other = compare.renamed({"customer": t.customer, "orders": orders}, {"customer": "x1", "orders": "x2"}, {"c_custkey": "y1", "c_mktsegment": "y2"})
    wide = t.customer.join(orders, "c_custkey").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"))
    first = ask(t.customer, orders, "c_custkey", "c_mktsegment")
    verdict = compare.equivalent([first, ask(other["x1"], other["x2"], "y1", "y2"), wide, first.withColumn("n", F.col("n") + 1)])
    return t.spark.createDataFrame([tuple(verdict)], "renamed_equal boolean, restructured_equal boolean, changed_equal boolean")
