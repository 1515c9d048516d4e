"""Comorbidity, baseline creatinine and details of stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.concepts.stays import YEAR_SECONDS
from tessera.functions.compat import decimal_text, seconds_between
from tessera.operators.codes import starts_with_any

# Prefixes of diagnosis codes by group and version of the code; a pair of prefixes is a range, both ends included.
CHARLSON: dict[str, tuple[tuple, tuple]] = {
    "myocardial_infarct": (("410", "412"), ("I21", "I22", "I252")),
    "congestive_heart_failure": (
        ("428", "39891", "40201", "40211", "40291", "40401", "40403", "40411", "40413", "40491", "40493", ("4254", "4259")),
        ("I43", "I50", "I099", "I110", "I130", "I132", "I255", "I420", "I425", "I426", "I427", "I428", "I429", "P290"),
    ),
    "peripheral_vascular_disease": (
        ("440", "441", "0930", "4373", "4471", "5571", "5579", "V434", ("4431", "4439")), ("I70", "I71", "I731", "I738", "I739", "I771", "I790", "I792", "K551", "K558", "K559", "Z958", "Z959"),
    ),
    "cerebrovascular_disease": ((("430", "438"), "36234"), ("G45", "G46", ("I60", "I69"), "H340")),
    "dementia": (("290", "2941", "3312"), ("F00", "F01", "F02", "F03", "G30", "F051", "G311")),
    "chronic_pulmonary_disease": ((("490", "505"), "4168", "4169", "5064", "5081", "5088"), (("J40", "J47"), ("J60", "J67"), "I278", "I279", "J684", "J701", "J703")),
    "rheumatic_disease": (("725", "4465", "7100", "7101", "7102", "7103", "7104", "7140", "7141", "7142", "7148"), ("M05", "M06", "M32", "M33", "M34", "M315", "M351", "M353", "M360")),
    "peptic_ulcer_disease": (("531", "532", "533", "534"), ("K25", "K26", "K27", "K28")),
    "mild_liver_disease": (
        ("570", "571", "0706", "0709", "5733", "5734", "5738", "5739", "V427", "07022", "07023", "07032", "07033", "07044", "07054"),
        ("B18", "K73", "K74", "K700", "K701", "K702", "K703", "K709", "K713", "K714", "K715", "K717", "K760", "K762", "K763", "K764", "K768", "K769", "Z944"),
    ),
    "diabetes_without_cc": (("2500", "2501", "2502", "2503", "2508", "2509"), tuple(f"E1{i}{j}" for i in range(5) for j in (0, 1, 6, 8, 9))),
    "diabetes_with_cc": (("2504", "2505", "2506", "2507"), tuple(f"E1{i}{j}" for i in range(5) for j in (2, 3, 4, 5, 7))),
    "paraplegia": (
        ("342", "343", "3341", "3440", "3441", "3442", "3443", "3444", "3445", "3446", "3449"), ("G81", "G82", "G041", "G114", "G801", "G802", "G830", "G831", "G832", "G833", "G834", "G839"),
    ),
    "renal_disease": (
        ("582", "585", "586", "V56", "5880", "V420", "V451", ("5830", "5837"), "40301", "40311", "40391", "40402", "40403", "40412", "40413", "40492", "40493"),
        ("N18", "N19", "I120", "I131", *(f"N03{i}" for i in range(2, 8)), *(f"N05{i}" for i in range(2, 8)), "N250", "Z490", "Z491", "Z492", "Z940", "Z992"),
    ),
    "malignant_cancer": (
        (("140", "172"), ("1740", "1958"), ("200", "208"), "2386"),
        ("C43", "C88", ("C00", "C26"), ("C30", "C34"), ("C37", "C41"), ("C45", "C58"), ("C60", "C76"), ("C81", "C85"), ("C90", "C97")),
    ),
    "severe_liver_disease": (("4560", "4561", "4562", ("5722", "5728")), ("I850", "I859", "I864", "I982", "K704", "K711", "K721", "K729", "K765", "K766", "K767")),
    "metastatic_solid_tumor": (("196", "197", "198", "199"), ("C77", "C78", "C79", "C80")),
    "aids": (("042", "043", "044"), ("B20", "B21", "B22", "B24")),
}
AGE_POINTS = ((50, 0), (60, 1), (70, 2), (80, 3))
GRADED = ("mild_liver_disease", "severe_liver_disease", "diabetes_with_cc", "diabetes_without_cc", "malignant_cancer", "metastatic_solid_tumor", "paraplegia", "renal_disease", "aids")
KIDNEY_CODES = {9: "585", 10: "N18"}


def has_code(code: Column, version: Column, groups: tuple[tuple, tuple]) -> Column:
    out = F.lit(False)
    for number, prefixes in zip((9, 10), groups, strict=True):
        test = starts_with_any(code, [p for p in prefixes if isinstance(p, str)])
        for low, high in (p for p in prefixes if not isinstance(p, str)):
            test = test | F.substring(code, 1, len(low)).between(low, high)
        out = out | ((version == number) & test)
    return out


def flags_of(diagnoses: DataFrame, groups: dict[str, tuple[tuple, tuple]]) -> DataFrame:
    """hadm_id and a 0/1 column for each group, in one aggregation."""
    return diagnoses.groupBy("hadm_id").agg(*[F.max(F.when(has_code(F.col("icd_code"), F.col("icd_version"), g), 1).otherwise(0)).alias(n) for n, g in groups.items()])


def charlson(admissions: DataFrame, diagnoses: DataFrame, age: DataFrame) -> DataFrame:
    """Seventeen groups of diagnoses by admission and their weighted sum with the points of age; of a mild and a severe group the worse counts."""
    flags = flags_of(diagnoses, CHARLSON)
    points = F.when(F.col("age") <= AGE_POINTS[0][0], AGE_POINTS[0][1])
    for limit, n in AGE_POINTS[1:]:
        points = points.when(F.col("age") <= limit, n)
    rows = admissions.select("subject_id", "hadm_id").join(flags, "hadm_id", "left").na.fill(0, list(CHARLSON)).join(age.select("hadm_id", points.otherwise(4).alias("age_score")), "hadm_id", "left")
    single = [F.col(n) for n in CHARLSON if n not in GRADED]
    graded = [
        F.greatest(F.col("mild_liver_disease"), 3 * F.col("severe_liver_disease")), F.greatest(2 * F.col("diabetes_with_cc"), F.col("diabetes_without_cc")),
        F.greatest(2 * F.col("malignant_cancer"), 6 * F.col("metastatic_solid_tumor")), 2 * F.col("paraplegia"), 2 * F.col("renal_disease"), 6 * F.col("aids"),
    ]
    return rows.select("subject_id", "hadm_id", "age_score", *CHARLSON, sum([*single, *graded], F.col("age_score")).alias("charlson_comorbidity_index"))


def creatinine_baseline(age: DataFrame, chemistry: DataFrame, diagnoses: DataFrame, patients: DataFrame) -> DataFrame:
    """Adults' creatinine: the least one where it is normal or the kidney is known to be ill, else the one at which the estimated filtration is 75."""
    adults = age.where("age >= 18").select("subject_id", "hadm_id", "age").join(patients.select("subject_id", "gender"), "subject_id", "left")
    ratio = F.lit(75.0 / 186.0) / F.pow("age", F.lit(-0.203))
    estimate = F.pow(F.when(F.col("gender") == "F", ratio / 0.742).otherwise(ratio), F.lit(-1 / 1.154))
    least = chemistry.groupBy("hadm_id").agg(F.min("creatinine").alias("scr_min"))
    ill = F.lit(False)
    for version, prefix in KIDNEY_CODES.items():
        ill = ill | ((F.col("icd_version") == version) & F.col("icd_code").startswith(prefix))
    known = diagnoses.where(ill).select("hadm_id").distinct().withColumn("ckd", F.lit(1))
    rows = adults.withColumn("mdrd_est", estimate).join(least, "hadm_id", "left").join(known, "hadm_id", "left")
    baseline = F.when((F.col("scr_min") <= 1.1) | (F.col("ckd") == 1), F.col("scr_min")).otherwise(F.col("mdrd_est"))
    return rows.select("hadm_id", "gender", "age", "scr_min", F.coalesce("ckd", F.lit(0)).alias("ckd"), "mdrd_est", baseline.alias("scr_baseline"))


def icustay_detail(icustays: DataFrame, admissions: DataFrame, patients: DataFrame) -> DataFrame:
    """Stays with their patient, admission, lengths and places in the sequence of admissions and stays."""
    entered = admissions.select("hadm_id", F.col("subject_id").alias("patient"), "admittime", "dischtime", "race", "hospital_expire_flag")
    rows = icustays.join(entered, "hadm_id").join(patients.select("subject_id", "gender", "dod", "anchor_age", "anchor_year"), "subject_id")
    hospital = F.dense_rank().over(Window.partitionBy("patient").orderBy(F.col("admittime").asc_nulls_first()))
    icu = F.dense_rank().over(Window.partitionBy("hadm_id").orderBy(F.col("intime").asc_nulls_first()))
    anchor = F.make_date("anchor_year", F.lit(1), F.lit(1)).cast("timestamp_ntz")
    rows = rows.withColumns({"hospstay_seq": hospital, "icustay_seq": icu})
    return rows.select(
        "subject_id", "hadm_id", "stay_id", "gender", "dod", "admittime", "dischtime", (seconds_between(F.col("admittime"), F.col("dischtime")) / 86400).alias("los_hospital"),
        (F.col("anchor_age") + seconds_between(anchor, F.col("admittime")) / YEAR_SECONDS).alias("admission_age"), "race", "hospital_expire_flag", "hospstay_seq", (F.col("hospstay_seq") == 1).alias("first_hosp_stay"),
        F.col("intime").alias("icu_intime"), F.col("outtime").alias("icu_outtime"), F.round(decimal_text(seconds_between(F.col("intime"), F.col("outtime")) / 86400), 2).alias("los_icu"), "icustay_seq",
        (F.col("icustay_seq") == 1).alias("first_icu_stay"),
    )
