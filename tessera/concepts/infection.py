"""Antibiotics, suspected infection and sepsis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.compat import matches_any
from tessera.operators.timeops import DAY, binned_interval_join

# Parts of names in lower case, routes and forms that don't count, and the organism that stands for a cancelled culture.
ANTIBIOTICS = (
    "adoxa", "ala-tet", "alodox", "amikacin", "amikin", "amoxicill", "amphotericin", "anidulafungin", "ancef", "clavulanate", "ampicillin", "augmentin", "avelox", "avidoxy", "azactam", "azithromycin", "aztreonam",
    "axetil", "bactocill", "bactrim", "bactroban", "bethkis", "biaxin", "bicillin l-a", "cayston", "cefazolin", "cedax", "cefoxitin", "ceftazidime", "cefaclor", "cefadroxil", "cefdinir", "cefditoren", "cefepime",
    "cefotan", "cefotetan", "cefotaxime", "ceftaroline", "cefpodoxime", "cefpirome", "cefprozil", "ceftibuten", "ceftin", "ceftriaxone", "cefuroxime", "cephalexin", "cephalothin", "cephapririn", "chloramphenicol",
    "cipro", "ciprofloxacin", "claforan", "clarithromycin", "cleocin", "clindamycin", "cubicin", "dicloxacillin", "dirithromycin", "doryx", "doxycy", "duricef", "dynacin", "ery-tab", "eryped", "eryc", "erythrocin",
    "erythromycin", "factive", "flagyl", "fortaz", "furadantin", "garamycin", "gentamicin", "kanamycin", "keflex", "kefzol", "ketek", "levaquin", "levofloxacin", "lincocin", "linezolid", "macrobid", "macrodantin",
    "maxipime", "mefoxin", "metronidazole", "meropenem", "methicillin", "minocin", "minocycline", "monodox", "monurol", "morgidox", "moxatag", "moxifloxacin", "mupirocin", "myrac", "nafcillin", "neomycin",
    "nicazel doxy 30", "nitrofurantoin", "norfloxacin", "noroxin", "ocudox", "ofloxacin", "omnicef", "oracea", "oraxyl", "oxacillin", "pc pen vk", "pce dispertab", "panixine", "pediazole", "penicillin", "periostat",
    "pfizerpen", "piperacillin", "tazobactam", "primsol", "proquin", "raniclor", "rifadin", "rifampin", "rocephin", "smz-tmp", "septra", "septra ds", "solodyn", "spectracef", "streptomycin", "sulfadiazine",
    "sulfamethoxazole", "trimethoprim", "sulfatrim", "sulfisoxazole", "suprax", "synercid", "tazicef", "tetracycline", "timentin", "tobramycin", "unasyn", "vancocin", "vancomycin", "vantin", "vibativ", "vibra-tabs",
    "vibramycin", "zinacef", "zithromax", "zosyn", "zyvox",
)
LOCAL_ROUTES, LOCAL_WAYS, LOCAL_FORMS = ("OU", "OS", "OD", "AU", "AS", "AD", "TP"), ("ear", "eye"), ("cream", "desensitization", "ophth oint", "gel")
CANCELLED = 90856


def antibiotic(prescriptions: DataFrame, icustays: DataFrame) -> DataFrame:
    """Antibiotics that act on the whole body, with the stay in which they began (start closed, end open). Without a route a prescription doesn't count.

    The tests make a list of (drug, route) pairs; every prescription of such a pair counts, one of a base solution too where the pair also occurs as a drug.
    """
    drug, route = F.col("drug"), F.col("route")
    pair = ~route.isin(*LOCAL_ROUTES) & ~matches_any(route, LOCAL_WAYS) & ~matches_any(drug, LOCAL_FORMS) & matches_any(drug, ANTIBIOTICS)
    own = F.coalesce(F.col("drug_type") != "BASE", F.lit(False))
    some = prescriptions.where(pair)
    # only rows that don't list their pair themselves are looked up, so the others are not moved to the few places of their pairs
    listed = some.where(own).select("drug", "route").distinct()
    rows = some.where(own).unionByName(some.where(~own).join(listed, ["drug", "route"], "left_semi").select(*some.columns))
    rows = rows.select("subject_id", "hadm_id", drug.alias("antibiotic"), "route", "starttime", "stoptime")
    joined = binned_interval_join(rows, icustays.select("hadm_id", "stay_id", "intime", "outtime"), "hadm_id", "starttime", "intime", "outtime", "left", width=4 * DAY)
    return joined.select("subject_id", "hadm_id", "stay_id", "antibiotic", "route", "starttime", "stoptime")


def suspicion_of_infection(antibiotics: DataFrame, microbiology: DataFrame) -> DataFrame:
    """Antibiotics with the first culture of the 72 hours (or three days) before them, else of the 24 hours (or the day) after."""
    order = [F.col(c).asc_nulls_first() for c in ("starttime", "stoptime", "antibiotic", "route", "hadm_id", "stay_id")]
    given = antibiotics.select("subject_id", "stay_id", "hadm_id", F.row_number().over(Window.partitionBy("subject_id").orderBy(*order)).alias("ab_id"), "antibiotic", F.col("starttime").alias("antibiotic_time"))
    grown = F.col("org_name").isNotNull() & (F.col("org_itemid") != CANCELLED) & (F.col("org_name") != "")
    cultures = microbiology.groupBy("micro_specimen_id").agg(
        F.max("subject_id").alias("patient"), F.max("chartdate").alias("chartdate"), F.max("charttime").alias("charttime"), F.max("spec_type_desc").alias("spec"), F.max(F.when(grown, 1).otherwise(0)).alias("positive")
    )
    at, day, time, date = F.col("antibiotic_time"), F.to_date("antibiotic_time"), F.col("charttime"), F.col("chartdate")
    timed = time.isNotNull()
    before = F.when(timed, (at > time) & (at <= time + F.expr("interval 72 hour"))).otherwise((day >= date) & (day <= F.date_add(date, 3)))
    after = F.when(timed, (at >= time - F.expr("interval 24 hour")) & (at < time)).otherwise((day >= F.date_sub(date, 1)) & (day <= date))
    # The earliest culture of each antibiotic on either side, by time where the culture has one, else by date: a patient's antibiotics and cultures meet once, and the rows stay in the patient's partition.
    found = F.struct("chartdate", F.coalesce("charttime", F.to_timestamp_ntz(F.lit("9999-01-01"))).alias("last"), "micro_specimen_id", F.coalesce("charttime", F.col("chartdate").cast("timestamp_ntz")).alias("time"), "spec", "positive")
    near = (F.col("subject_id") == F.col("patient")) & (F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False)))
    rows = given.join(cultures, near, "left").groupBy("subject_id", "ab_id").agg(
        *[F.first(c).alias(c) for c in given.columns if c not in ("subject_id", "ab_id")], F.min(F.when(before, found)).alias("before"), F.min(F.when(after, found)).alias("after")
    )
    suspected = F.col("before.spec").isNotNull() | F.col("after.spec").isNotNull()
    return rows.select(
        "subject_id", "stay_id", "hadm_id", "ab_id", "antibiotic", "antibiotic_time", suspected.cast("int").alias("suspected_infection"), F.when(suspected, F.coalesce("before.time", "antibiotic_time")).alias("suspected_infection_time"),
        F.coalesce("before.time", "after.time").alias("culture_time"), F.coalesce("before.spec", "after.spec").alias("specimen"), F.coalesce("before.positive", "after.positive").alias("positive_culture"),
    )


def last_times(infections: DataFrame) -> DataFrame:
    """stay_id, until: the last time of organ failure that sepsis3 takes of each stay with a suspected infection; no other stay has a row there."""
    return infections.where("stay_id is not null").groupBy("stay_id").agg((F.max("suspected_infection_time") + F.expr("interval 24 hour")).alias("until")).where("until is not null")


def sepsis3(sofa: DataFrame, infections: DataFrame) -> DataFrame:
    """The first suspected infection of a stay with two points of organ failure or more from 48 hours before it to 24 hours after."""
    organs = ("respiration", "coagulation", "liver", "cardiovascular", "cns", "renal")
    worst = sofa.where("sofa_24hours >= 2").select(F.col("stay_id").alias("s"), F.col("endtime").alias("sofa_time"), F.col("sofa_24hours").alias("sofa_score"), *[F.col(f"{o}_24hours").alias(o) for o in organs])
    when = F.col("suspected_infection_time")
    near = (F.col("stay_id") == F.col("s")) & (F.col("sofa_time") >= when - F.expr("interval 48 hour")) & (F.col("sofa_time") <= when + F.expr("interval 24 hour"))
    order = [F.col(c).asc_nulls_first() for c in ("suspected_infection_time", "antibiotic_time", "culture_time", "sofa_time", "ab_id")]
    rows = infections.join(worst, near).withColumn("nth", F.row_number().over(Window.partitionBy("stay_id").orderBy(*order))).where("nth = 1")
    verdict = (F.col("sofa_score") >= 2) & (F.col("suspected_infection") == 1)
    return rows.select("subject_id", "stay_id", "antibiotic_time", "culture_time", "suspected_infection_time", "sofa_time", "sofa_score", *organs, verdict.alias("sepsis3"))
