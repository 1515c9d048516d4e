"""Data-quality metrics over the unified long format (one row for each value of each source column)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.compat import any_date, divide, round_scaled
from tessera.operators.timeops import asof_latest

LONG_COLUMNS = (
    "Primary_key", "Variable_ID", "Original_table_name", "Variable_name", "Event_date", "Value", "Unit", "Variable_type", "Is_categorical", "Recorder",
    "Recorder_position", "Recorder_affiliation", "Patient_id", "Admission_id", "Ground_truth", "Mapping_info_1", "Mapping_info_2",
)
BY = ["Original_table_name", "Variable_name"]


def to_long(df: DataFrame, table: str, key: str, values: Sequence[str], patient: str | None = None, date: str | None = None, categorical: Sequence[str] = ()) -> DataFrame:
    """Unpivot a wide table to the long format; null values become blank, as the format's builder has it."""
    ids = {"Primary_key": F.col(key).cast("long"), "Patient_id": F.col(patient).cast("string") if patient else F.lit(None).cast("string")}
    ids["Event_date"] = F.date_format(F.col(date), "yyyy-MM-dd HH:mm:ss") if date else F.lit(None).cast("string")
    wide = df.select(*[c.alias(n) for n, c in ids.items()], *[F.coalesce(F.col(v).cast("string"), F.lit("")).alias(v) for v in values])
    long = wide.unpivot(list(ids), list(values), "Variable_name", "Value")
    long = long.withColumns({"Original_table_name": F.lit(table.upper()), "Is_categorical": F.col("Variable_name").isin(*categorical).cast("int").cast("string")})
    return long.select(*[F.col(c) if c in long.columns else F.lit(None).cast("string").alias(c) for c in LONG_COLUMNS])


def completeness(long: DataFrame) -> DataFrame:
    present = F.count(F.when(F.col("Value") != "", 1))
    return long.groupBy(*BY).agg(F.count("*").alias("n_total"), present.alias("n_present"), round_scaled(present * 100 / F.count("*"), 2).alias("completeness"))


def class_diversity(long: DataFrame) -> DataFrame:
    """1 - sum of squared class shares in per cent, 100 where every value is unique; the entropy of the shares in bits beside it. Notes, codes and dates don't count."""
    kinds = F.coalesce(F.lower("Mapping_info_1"), F.lit("")).rlike("note|code|date")
    counts = long.where("Is_categorical = '1' and Value != ''").where(~kinds).groupBy(*BY, "Value").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*BY))
    out = counts.withColumns({"p2": share * share, "h": -share * F.log2(share)}).groupBy(*BY).agg(F.count("*").alias("classes"), F.sum("n").alias("n"), F.sum("p2").alias("s"), F.sum("h").alias("h"))
    return out.select(*BY, "classes", "n", round_scaled(F.col("h"), 6).alias("shannon"), F.when(F.col("classes") == F.col("n"), 100.0).otherwise(round_scaled((1 - F.col("s")) * 100, 2)).alias("diversity"))


FIDELITY_KINDS = ("event", "diagnosis", "prescription", "procedure")  # fixed values: kinds in Mapping_info_1; all but events count by value


def fidelity_by_kind(long: DataFrame) -> DataFrame:
    """Mean and deviation, to two digits, of how often a patient has a variable (events) or a value (diagnoses, prescriptions, procedures)."""
    kind = F.lower("Mapping_info_1")
    rows = long.where(kind.isin(*FIDELITY_KINDS) & (F.col("Value") != "") & F.col("Patient_id").isNotNull()).select(kind.alias("kind"), *BY, F.when(kind != "event", F.col("Value")).alias("item"), "Patient_id")
    per = rows.groupBy("kind", *BY, "item", "Patient_id").agg(F.count("*").alias("n"))
    return per.groupBy("kind", *BY, "item").agg(F.count("*").alias("patients"), round_scaled(F.avg("n"), 2).alias("mean_n"), round_scaled(F.stddev_samp("n"), 2).alias("std_n"))


def fidelity_total(by_kind: DataFrame) -> DataFrame:
    """The means of a kind, weighted by patients."""
    return by_kind.groupBy("kind").agg(F.sum("patients").alias("patients"), round_scaled(F.sum(F.col("mean_n") * F.col("patients")) / F.sum("patients"), 2).alias("mean_n"))


def fidelity(long: DataFrame) -> DataFrame:
    """Mean and deviation of the number of values that a patient has of a variable."""
    per = long.where("Value != '' and Patient_id is not null").groupBy(*BY, "Patient_id").agg(F.count("*").alias("n"))
    return per.groupBy(*BY).agg(F.count("*").alias("patients"), round_scaled(F.avg("n"), 4).alias("mean_n"), round_scaled(F.stddev_samp("n"), 4).alias("std_n"))


def instance_diversity(long: DataFrame) -> DataFrame:
    """For each class: patients over occurrences, and the unnormalised Gini index of how often patients have it."""
    per = long.where("Is_categorical = '1' and Value != '' and Patient_id is not null").groupBy(*BY, "Value", "Patient_id").agg(F.count("*").alias("c"))
    level = per.groupBy(*BY, "Value", "c").agg(F.count("*").alias("k"))
    n = F.sum(F.col("k") * F.col("c"))
    out = level.groupBy(*BY, "Value").agg(F.sum("k").alias("patients"), n.alias("occurrences"), F.sum(F.col("k") * F.col("k")).alias("k2"))
    return out.select(*BY, "Value", "patients", "occurrences", round_scaled(1 - divide(F.col("k2"), F.col("occurrences") * F.col("occurrences")), 6).alias("gini"))


def quartiles(numbers: DataFrame, by: list[str], value: str) -> DataFrame:
    """q1, q3 and n of each group: values are counted first, so a group sends a row for each distinct value, and the two neighbours of each quartile are found by running counts."""
    counts = numbers.groupBy(*by, value).agg(F.count("*").alias("_c"))
    line = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumns({"_upto": F.sum("_c").over(line), "_n": F.sum("_c").over(Window.partitionBy(*by))})
    out = []
    for name, p in (("q1", 0.25), ("q3", 0.75)):
        at = (F.col("_n") - 1) * p
        low, high = F.min(F.when(F.col("_upto") > F.floor(at), F.col(value))), F.min(F.when(F.col("_upto") > F.ceil(at), F.col(value)))
        share = F.first((F.col("_n") - 1) * p - F.floor((F.col("_n") - 1) * p))
        out.append((low + (high - low) * share).alias(name))
    return counts.groupBy(*by).agg(*out, F.first("_n").alias("n"))


def range_validity(long: DataFrame, least: int = 1000) -> DataFrame:
    """Shares of numbers below, within and above 1.5 interquartile ranges of the quartiles, by table and variable. Quartiles are those of a variable over all tables, for
    variables of more than `least` numbers."""
    numbers = long.withColumn("x", F.col("Value").try_cast("double")).where("x is not null")
    q = quartiles(numbers.select("Variable_name", "x"), ["Variable_name"], "x").where(F.col("n") > least)
    q = q.select("Variable_name", (F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("low"), (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("high"))
    counted = numbers.groupBy(*BY, "x").agg(F.count("*").alias("c")).join(F.broadcast(q), "Variable_name")  # bounds: a row for each variable
    n, under, over = F.sum("c"), F.sum(F.when(F.col("x") < F.col("low"), F.col("c")).otherwise(0)), F.sum(F.when(F.col("x") > F.col("high"), F.col("c")).otherwise(0))
    return counted.groupBy(*BY).agg(n.alias("n"), under.alias("n_under"), over.alias("n_over"), round_scaled((n - under - over) * 100 / n, 2).alias("validity"))


def date_validity(long: DataFrame) -> DataFrame:
    good = any_date(F.col("Event_date")).isNotNull()
    return long.where("Event_date is not null").groupBy(*BY).agg(F.count("*").alias("n"), round_scaled(F.count_if(good) * 100 / F.count("*"), 2).alias("validity"))


def format_validity(long: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Share of values that match their variable's pattern; variables without one are left out."""
    pattern = F.element_at(F.create_map(*[F.lit(x) for kv in patterns.items() for x in kv]), F.col("Variable_name"))
    rows = long.where(F.col("Variable_name").isin(*patterns) & (F.col("Value") != "")).withColumn("ok", F.regexp_like("Value", pattern))
    return rows.groupBy(*BY).agg(F.count("*").alias("n"), round_scaled(F.count_if("ok") * 100 / F.count("*"), 2).alias("validity"))


# Kinds of codes, what names or describes them, and their form; the first that fits counts.
CODE_KINDS = (
    ("ICD-9", ("icd", "9"), r"^[0-9]{3}(\.[0-9]{1,2})?$"), ("ICD-10", ("icd", "10"), r"^[A-Z]{1}[0-9]{2}(\.[0-9]{1,2})?$"),
    ("ICD-11", ("icd", "11"), r"^[A-Z0-9]{1}[A-Z]{1}[0-9]{1}[A-Z0-9]{1}(\.[A-Z0-9]{1,2})?$"), ("SNOMED-CT", ("snomed", "ct"), r"^[0-9]{6,18}$"), ("RxNorm", ("rxnorm",), r"^[0-9]{5,9}$"),
    ("LOINC", ("loinc",), r"^[0-9]{1,6}\-[0-9]{1}$"), ("ATC", ("atc",), r"^[A-Z]{1}[0-9]{2}[A-Z]{2}[0-9]{2}$"),
)


def code_pattern(name: Column, description: Column) -> Column:
    """The form of the codes of a variable, from words in its name or its description; null where none fits."""
    out = F.lit(None).cast("string")
    for _, words, pattern in reversed(CODE_KINDS):
        fits = [reduce(lambda a, b: a & b, [F.lower(F.coalesce(text, F.lit(""))).contains(w) for w in words]) for text in (name, description)]
        out = F.when(fits[0] | fits[1], pattern).otherwise(out)
    return out


def code_validity(long: DataFrame, dictionary: DataFrame, further: DataFrame | None = None) -> DataFrame:
    """For each variable of codes: n, pattern, n_invalid and the share of values of the form of its kind. dictionary: Original_table_name, Variable_name, Description; further: Variable_name and pattern
    for kinds that have no rule. Values of a variable that neither tells are invalid, and its pattern is empty."""
    rows = long.where(F.lower("Mapping_info_1").contains("medical_code") & F.col("Value").isNotNull()).select(*BY, "Value")
    known = dictionary.groupBy(*BY).agg(F.first(code_pattern(F.col("Variable_name"), F.col("Description")), ignorenulls=True).alias("pattern"))
    if further is not None:
        more = further.groupBy("Variable_name").agg(F.min("pattern").alias("other"))
        known = known.join(more, "Variable_name", "left").withColumn("pattern", F.coalesce("pattern", "other")).drop("other")
    joined = rows.groupBy(*BY, "Value").agg(F.count("*").alias("c")).join(known, BY, "left")  # equal values are judged once
    good = F.coalesce(F.regexp_like("Value", F.col("pattern")), F.lit(False))
    per = joined.groupBy(*BY).agg(F.sum("c").alias("n"), F.coalesce(F.first("pattern"), F.lit("")).alias("pattern"), F.sum(F.when(good, 0).otherwise(F.col("c"))).alias("n_invalid"))
    return per.withColumn("validity", round_scaled((F.col("n") - F.col("n_invalid")) * 100 / F.col("n"), 2))


def mapped_dates(long: DataFrame) -> DataFrame:
    """The long format's dates as rows of date_validity: the dates of records, under the variable Event_date, and the values of variables that are mapped as dates."""
    recorded = long.select("Original_table_name", F.lit("Event_date").alias("Variable_name"), "Event_date")
    valued = long.where(F.lower("Mapping_info_1").contains("date")).select("Original_table_name", "Variable_name", F.col("Value").alias("Event_date"))
    return recorded.unionByName(valued)


def sequence_validity_long(long: DataFrame, pairs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Original_table_name, start_var, end_var, n, n_invalid, validity for (table, start, end) pairs of variables mapped as dates: values of one patient, table and row key are held against each other; unreadable
    dates and dates without a partner don't count. Ends are met by one grouping on the three keys; a start or end that a row has several times meets each of the other's."""
    at = any_date(F.col("Value"))
    ends = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(v).alias("v"), F.lit(i).alias("pair"), F.lit(side).alias("side")) for i, (t, *both) in enumerate(pairs) for side, v in enumerate(both)])
    known = long.sparkSession.range(1).select(F.explode(ends).alias("e")).select("e.*")
    dated = long.where(F.lower("Mapping_info_1").contains("date") & F.col("Patient_id").isNotNull() & F.col("Primary_key").isNotNull())
    met = dated.join(F.broadcast(known), (F.col("Original_table_name") == F.col("t")) & (F.col("Variable_name") == F.col("v")))  # two rows for each pair asked for
    met = met.select("Patient_id", "Original_table_name", "Primary_key", "pair", "side", at.alias("at"))  # a null makes no pair
    sides = [F.collect_list(F.when(F.col("side") == i, F.col("at"))).alias(n) for i, n in enumerate(("starts", "ends"))]
    rows = met.groupBy("Patient_id", "Original_table_name", "Primary_key", "pair").agg(*sides)
    good = F.aggregate("starts", F.lit(0).cast("long"), lambda total, s: total + F.size(F.filter("ends", lambda e: s <= e)))
    rows = rows.select("pair", (F.size("starts").cast("long") * F.size("ends")).alias("n"), good.alias("good")).where("n > 0")
    names = [F.element_at(F.array(*[F.lit(p[k]) for p in pairs]), F.col("pair") + 1).alias(n) for k, n in enumerate(("Original_table_name", "start_var", "end_var"))]
    per = rows.groupBy("pair").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    return per.select(*names, "n", (F.col("n") - F.col("good")).alias("n_invalid"), round_scaled(F.col("good") * 100 / F.col("n"), 2).alias("validity"))


def sequence_validity(df: DataFrame, table: str, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """For each (start, end) pair: rows where both are known, and the share in order."""
    both = [F.struct(F.lit(f"{a}<={b}").alias("pair"), F.col(a).isNotNull().__and__(F.col(b).isNotNull()).alias("known"), (F.col(a) <= F.col(b)).alias("ok")) for a, b in pairs]
    rows = df.select(F.explode(F.array(*both)).alias("p")).select("p.*").where("known")
    return rows.groupBy("pair").agg(F.lit(table).alias("table_name"), F.count("*").alias("n"), round_scaled(F.count_if("ok") * 100 / F.count("*"), 2).alias("validity"))


SCALES = (1000.0, 100.0, 10.0, 1.0, 0.1)  # fixed values: the scales at which a last digit is looked for, in this order


def preciseness(long: DataFrame, least: int = 1000, most: float = 0.99) -> DataFrame:
    """Gini index of the last digit of numbers, at the first scale at which no more than `most` of them end in 0: even digits give 0.9, rounding less.

    Numbers are rounded to three digits first. All scales are counted in one pass.
    """
    numbers = long.withColumn("x", F.col("Value").try_cast("double")).where("x is not null")
    scaled = numbers.select(*BY, F.explode(F.array(*[F.struct(F.lit(i).alias("scale"), F.pmod(F.abs(F.round(F.round(F.col("x") * 1000, 0) * (f / 1000), 0)).cast("long"), F.lit(10)).alias("d")) for i, f in enumerate(SCALES)])).alias("s"))
    counts = scaled.select(*BY, "s.*").groupBy(*BY, "scale", "d").agg(F.count("*").alias("n"))
    per = counts.groupBy(*BY, "scale").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("d") == 0, F.col("n")).otherwise(0)).alias("zeros"), F.sum(F.col("n").cast("double") * F.col("n")).alias("s"))
    good = per.where((F.col("n") > least) & ((F.col("zeros") <= most * F.col("n")) | (F.col("scale") == len(SCALES) - 1)))
    first = good.groupBy(*BY).agg(F.min_by(F.struct("n", "s", "scale"), "scale").alias("p"))
    return first.select(*BY, F.col("p.n").alias("n"), F.element_at(F.array(*map(F.lit, SCALES)), F.col("p.scale") + 1).alias("scale"), round_scaled(1 - F.col("p.s") / (F.col("p.n").cast("double") * F.col("p.n")), 6).alias("gini"))


def classification(df: DataFrame, by: str, truth: str, guess: str) -> DataFrame:
    """Accuracy, macro precision, recall and F1 (0 where undefined) and the mean one-vs-rest area of hard labels, from counts of (truth, guess) only."""
    cells = df.where(f"{truth} is not null and {guess} is not null").groupBy(by, F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count("*").alias("n"))
    sides = cells.select(by, F.explode(F.array(F.struct(F.col("t").alias("label"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("said"), F.when(F.col("t") == F.col("g"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("g").alias("label"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("said"), F.lit(0).cast("long").alias("hit")))).alias("s")).select(by, "s.*")
    labels = sides.groupBy(by, "label").agg(F.sum("actual").alias("actual"), F.sum("said").alias("said"), F.sum("hit").alias("hit"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    p, r = zero(divide(F.col("hit"), F.col("said"))), zero(divide(F.col("hit"), F.col("actual")))
    labels = labels.withColumns({"p": p, "r": r}).withColumn("f", zero(divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r"))))
    total = F.sum("actual").over(Window.partitionBy(by))
    rest = total - F.col("actual")
    labels = labels.withColumn("area", F.when((F.col("actual") > 0) & (rest > 0), (F.col("hit") / F.col("actual") + 1 - (F.col("said") - F.col("hit")) / rest) / 2))
    return labels.groupBy(by).agg(
        round_scaled(F.avg("area"), 3).alias("auc"), F.sum("actual").alias("n"), round_scaled(F.sum("hit") / F.sum("actual"), 3).alias("accuracy"), round_scaled(F.avg("p"), 3).alias("macro_precision"),
        round_scaled(F.avg("r"), 3).alias("macro_recall"), round_scaled(F.avg("f"), 3).alias("macro_f1"),
    )


def group_disparity(df: DataFrame, group: str, metric: str, by: str) -> DataFrame:
    """Largest distance of a group's mean from the mean of the groups' means."""
    per = df.groupBy(by, group).agg(F.avg(metric).alias("m"))
    middle = F.avg("m").over(Window.partitionBy(by))
    return per.withColumn("d", F.abs(F.col("m") - middle)).groupBy(by).agg(F.count("*").alias("groups"), round_scaled(F.max("d"), 4).alias("disparity"))


def _coverage(counts: DataFrame, by: str, percents: Sequence[int]) -> DataFrame:
    """Of counts (by, n): how many items and distinct ones, and the share of items that the most frequent p per cent of distinct ones cover.

    Distinct items of one frequency are alike, so only their number is ranked: a group sends one row for each frequency, not for each word.
    """
    levels = counts.groupBy(by, "n").agg(F.count("*").alias("k"))
    line = Window.partitionBy(by).orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    levels = levels.withColumns({"upto": F.sum("k").over(line), "types": F.sum("k").over(Window.partitionBy(by))})
    cover = []
    for p in percents:
        wanted = F.floor(F.col("types") * p / 100)
        taken = F.greatest(F.lit(0), F.least(F.col("k"), wanted - (F.col("upto") - F.col("k"))))
        cover.append(round_scaled(F.sum(taken * F.col("n")) * 100 / F.sum(F.col("n") * F.col("k")), 2).alias(f"cover_{p}"))
    total = F.sum(F.col("n") * F.col("k"))
    return levels.groupBy(by).agg(total.alias("tokens"), F.sum("k").alias("types"), round_scaled(F.sum("k") * 100 / total, 2).alias("diversity"), *cover)


def ascii_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def sentences(text: Column) -> Column:
    """Parts between blank lines or closing punctuation, trimmed; empty ones go."""
    return F.filter(F.transform(F.split(text, r"\n[ \t]*\n|[.!?]+"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")


def vocabulary_coverage(docs: DataFrame, text: str, by: str, percents: Sequence[int] = (5, 10, 20), tokenize: Callable[[Column], Column] = ascii_words) -> DataFrame:
    """Distinct over all tokens, and the share of tokens that the most frequent p per cent of types cover; tokenize: text to an array of tokens."""
    tokens = docs.select(by, F.explode(tokenize(F.col(text))).alias("token"))
    return _coverage(tokens.groupBy(by, "token").agg(F.count("*").alias("n")), by, percents)


def sentence_diversity(docs: DataFrame, text: str, by: str, percents: Sequence[int] = (5, 10, 20), keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """The same for sentences; keep tells which of them count (those with a verb, where a tagger is at hand)."""
    found = docs.select(by, F.explode(sentences(F.col(text))).alias("token"))
    found = found.where(keep(F.col("token"))) if keep else found
    return _coverage(found.groupBy(by, "token").agg(F.count("*").alias("n")), by, percents)


def context_values(targets: DataFrame, others: DataFrame, patient: str, time: str, names: Sequence[str], days: int = 7) -> DataFrame:
    """targets with the latest value of each named variable at most so many days before; others: patient, time, name, value."""
    out = targets
    for name in names:
        one = others.where(F.col("name") == name).groupBy(patient, F.col(time).alias("_at")).agg(F.max("value").alias(name))
        out = asof_latest(out, one, patient, time, "_at", days * 86_400, [name], "_at").drop("_at_matched")
    return out


def attribute_score(df: DataFrame, key: str, attributes: Sequence[str]) -> DataFrame:
    """key, present, score: how many of the attributes have a value, and that in whole per cent, rounded down."""
    present = sum((F.col(a).isNotNull().cast("int") for a in attributes), F.lit(0))
    return df.select(key, present.alias("present"), F.floor(present * 100 / len(attributes)).cast("int").alias("score"))


def mention_rate(answers: DataFrame, by: str, text: str) -> DataFrame:
    """Model answers as lines of "name: Yes" or "name: No": the share of Yes by answer, then mean and deviation by kind of note."""
    yes, no = (F.size(F.regexp_extract_all(F.col(text), F.lit(rf"(?im)^[^:\n]+:\s*{word}\b"), F.lit(0))) for word in ("yes", "no"))
    rated = answers.select(by, divide(yes * 100.0, yes + no).alias("rate")).where("rate is not null")
    return rated.groupBy(by).agg(F.count("*").alias("n"), round_scaled(F.avg("rate"), 2).alias("mean_rate"), round_scaled(F.stddev_samp("rate"), 2).alias("std_rate"))


def synonym_consistency(counts: DataFrame, group: str, n: str) -> DataFrame:
    """Sum of n^2 / N over groups of synonyms, in parts of all values."""
    per = counts.groupBy(group).agg(F.sum(n).alias("total"), F.sum(F.col(n).cast("double") * F.col(n)).alias("s"))
    return per.agg(round_scaled(F.sum(F.col("s") / F.col("total")) / F.sum("total"), 6).alias("consistency"))


def describe_variables(long: DataFrame, documented: DataFrame | None = None) -> DataFrame:
    """Original_table_name, Variable_name, Description for every variable of the long format.

    documented: Variable_name, Description and perhaps Original_table_name (case folded), from a data dictionary or from a model's answers; a text for the table and variable comes before one for the variable alone, and
    one that begins with NO_DESC is none. What nothing describes is a clinical measurement in tables of events, else a column of its table.
    """
    variables = long.select(*BY).where("Original_table_name is not null and Variable_name is not null").distinct()
    plain = F.when(F.upper("Original_table_name").endswith("EVENTS"), F.concat(F.lit("Clinical measurement: "), "Variable_name")).otherwise(
        F.concat(F.lit("Column "), F.col("Variable_name"), F.lit(" of the table "), F.col("Original_table_name"))
    )
    if documented is None:
        return variables.select(*BY, plain.alias("Description"))
    texts = documented.where(F.trim("Description") != "").where(~F.upper(F.trim("Description")).startswith("NO_DESC"))
    table = F.upper("Original_table_name") if "Original_table_name" in documented.columns else F.lit(None).cast("string")
    texts = texts.groupBy(table.alias("_table"), F.lower("Variable_name").alias("_variable")).agg(F.min("Description").alias("_text"))
    own, general = texts.where("_table is not null"), texts.where("_table is null").select("_variable", F.col("_text").alias("_general"))
    joined = variables.withColumns({"_table": F.upper("Original_table_name"), "_variable": F.lower("Variable_name")}).join(own, ["_table", "_variable"], "left").join(general, "_variable", "left")
    return joined.select(*BY, F.coalesce("_text", "_general", plain).alias("Description"))
