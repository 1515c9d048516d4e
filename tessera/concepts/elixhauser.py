"""Elixhauser groups of diagnoses (Quan and others, 2005), their count and the weighted sum of van Walraven and others (2009)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.concepts.comorbidity import flags_of


def _run(letter: str, *spans: tuple[int, int]) -> tuple[str, ...]:
    """Prefixes of a letter (or none) and numbers of two or three digits, listed one by one: letters within a code's number don't count."""
    width = 2 if letter else 3
    return tuple(f"{letter}{i:0{width}d}" for low, high in spans for i in range(low, high + 1))


# Prefixes of codes by group for versions 9 and 10.
GROUPS: dict[str, tuple[tuple, tuple]] = {
    "congestive_heart_failure": (
        ("428", "4254", "4255", "4257", "4258", "4259", "39891", "40201", "40211", "40291", "40401", "40403", "40411", "40413", "40491", "40493"),
        ("I43", "I50", "I099", "I110", "I130", "I132", "I255", "I420", "I425", "I426", "I427", "I428", "I429", "P290"),
    ),
    "cardiac_arrhythmias": (
        ("4260", "4267", "4269", "4270", "4271", "4272", "4273", "4274", "4276", "4278", "4279", "7850", "V450", "V533", "42610", "42612", "42613", "99601", "99604"),
        ("I47", "I48", "I49", "I441", "I442", "I443", "I456", "I459", "R000", "R001", "R008", "T821", "Z450", "Z950"),
    ),
    "valvular_disease": (
        ("394", "395", "396", "397", "424", "0932", "7463", "7464", "7465", "7466", "V422", "V433"),
        (*_run("I", (5, 8), (34, 39)), "A520", "I091", "I098", "Q230", "Q231", "Q232", "Q233", "Z952", "Z954"),
    ),
    "pulmonary_circulation": (("416", "4150", "4151", "4170", "4178", "4179"), ("I26", "I27", "I280", "I288", "I289")),
    "peripheral_vascular": (
        ("440", "441", "0930", "4373", "4431", "4432", "4438", "4439", "4471", "5571", "5579", "V434"), ("I70", "I71", "I731", "I738", "I739", "I771", "I790", "I792", "K551", "K558", "K559", "Z958", "Z959"),
    ),
    "hypertension": (("401", "402", "403", "404", "405"), ("I10", "I11", "I12", "I13", "I15")),
    "paralysis": (
        ("342", "343", "3341", "3440", "3441", "3442", "3443", "3444", "3445", "3446", "3449"), ("G81", "G82", "G041", "G114", "G801", "G802", "G830", "G831", "G832", "G833", "G834", "G839"),
    ),
    "other_neurological": (
        ("334", "335", "340", "341", "345", "3319", "3320", "3321", "3334", "3335", "3362", "3481", "3483", "7803", "7843", "33392"),
        (*_run("G", (10, 13), (20, 22), (32, 32), (35, 37), (40, 41)), "R56", "G254", "G255", "G312", "G318", "G319", "G931", "G934", "R470"),
    ),
    "chronic_pulmonary": ((*_run("", (490, 496), (500, 505)), "4168", "4169", "5064", "5081", "5088"), (*_run("J", (40, 47), (60, 67)), "I278", "I279", "J684", "J701", "J703")),
    "diabetes_uncomplicated": (("2500", "2501", "2502", "2503"), tuple(f"E1{i}{j}" for i in range(5) for j in (0, 1, 9))),
    "diabetes_complicated": (("2504", "2505", "2506", "2507", "2508", "2509"), tuple(f"E1{i}{j}" for i in range(5) for j in range(2, 9))),
    "hypothyroidism": (("243", "244", "2409", "2461", "2468"), ("E00", "E01", "E02", "E03", "E890")),
    "renal_failure": (
        ("585", "586", "V56", "5880", "V420", "V451", "40301", "40311", "40391", "40402", "40403", "40412", "40413", "40492", "40493"),
        ("N18", "N19", "I120", "I131", "N250", "Z490", "Z491", "Z492", "Z940", "Z992"),
    ),
    "liver_disease": (
        ("570", "571", "0706", "0709", "4560", "4561", "4562", "5722", "5723", "5724", "5728", "5733", "5734", "5738", "5739", "V427", "07022", "07023", "07032", "07033", "07044", "07054"),
        ("B18", "I85", "K70", "K72", "K73", "K74", "I864", "I982", "K711", "K713", "K714", "K715", "K717", "K760", *(f"K76{i}" for i in range(2, 10)), "Z944"),
    ),
    "peptic_ulcer": (("5317", "5319", "5327", "5329", "5337", "5339", "5347", "5349"), ("K257", "K259", "K267", "K269", "K277", "K279", "K287", "K289")),
    "aids": (("042", "043", "044"), ("B20", "B21", "B22", "B24")),
    "lymphoma": (("200", "201", "202", "2030", "2386"), ("C81", "C82", "C83", "C84", "C85", "C88", "C96", "C900", "C902")),
    "metastatic_cancer": (("196", "197", "198", "199"), ("C77", "C78", "C79", "C80")),
    "solid_tumor": (_run("", (140, 172), (174, 195)), _run("C", (0, 26), (30, 34), (37, 41), (43, 43), (45, 58), (60, 76), (97, 97))),
    "rheumatoid_arthritis": (
        ("446", "714", "720", "725", "7010", "7100", "7101", "7102", "7103", "7104", "7108", "7109", "7112", "7193", "7285", "72889", "72930"),
        ("M05", "M06", "M08", "M30", "M32", "M33", "M34", "M35", "M45", "L940", "L941", "L943", "M120", "M123", "M310", "M311", "M312", "M313", "M461", "M468", "M469"),
    ),
    "coagulopathy": (("286", "2871", "2873", "2874", "2875"), ("D65", "D66", "D67", "D68", "D691", "D693", "D694", "D695", "D696")),
    "obesity": (("2780",), ("E66",)),
    "weight_loss": (("260", "261", "262", "263", "7832", "7994"), (*_run("E", (40, 46)), "R64", "R634")),
    "fluid_electrolyte": (("276", "2536"), ("E86", "E87", "E222")),
    "blood_loss_anemia": (("2800",), ("D500",)),
    "deficiency_anemias": (("281", "2801", "2808", "2809"), ("D51", "D52", "D53", "D508", "D509")),
    "alcohol_abuse": (
        ("980", "2652", "2911", "2912", "2913", "2915", "2918", "2919", "3030", "3039", "3050", "3575", "4255", "5353", "5710", "5711", "5712", "5713", "V113"),
        ("E52", "F10", "T51", "G621", "I426", "K292", "K700", "K703", "K709", "Z502", "Z714", "Z721"),
    ),
    "drug_abuse": (("292", "304", *(f"305{i}" for i in range(2, 10)), "V6542"), (*_run("F", (11, 16), (18, 19)), "Z715", "Z722")),
    "psychoses": (("295", "297", "298", "2938", "29604", "29614", "29644", "29654"), ("F20", *_run("F", (22, 25)), "F28", "F29", "F302", "F312", "F315")),
    "depression": (("309", "311", "2962", "2963", "2965", "3004"), ("F32", "F33", "F204", "F313", "F314", "F315", "F341", "F412", "F432")),
}
#: Of each pair the milder group counts only without the graver one.
GRAVER = {"diabetes_uncomplicated": "diabetes_complicated", "solid_tumor": "metastatic_cancer"}
#: Groups that aren't named weigh nothing.
WEIGHTS = {
    "congestive_heart_failure": 7, "cardiac_arrhythmias": 5, "valvular_disease": -1, "pulmonary_circulation": 4, "peripheral_vascular": 2, "paralysis": 7, "other_neurological": 6, "chronic_pulmonary": 3,
    "renal_failure": 5, "liver_disease": 11, "lymphoma": 9, "metastatic_cancer": 12, "solid_tumor": 4, "coagulopathy": 3, "obesity": -4, "weight_loss": 6, "fluid_electrolyte": 5, "blood_loss_anemia": -2,
    "deficiency_anemias": -2, "drug_abuse": -7, "depression": -3,
}


def elixhauser(admissions: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """Thirty groups by admission from all but the first diagnosis, how many there are and their weighted sum; admissions without codes have none."""
    rows = admissions.select("subject_id", "hadm_id").join(flags_of(diagnoses.where("seq_num <> 1"), GROUPS), "hadm_id", "left").na.fill(0, list(GROUPS))
    rows = rows.withColumns({mild: F.when(F.col(grave) == 1, 0).otherwise(F.col(mild)) for mild, grave in GRAVER.items()})
    count, weighted = sum((F.col(n) for n in GROUPS), F.lit(0)), sum((F.col(n) * w for n, w in WEIGHTS.items()), F.lit(0))
    return rows.select("subject_id", "hadm_id", *GROUPS, count.alias("elixhauser_count"), weighted.alias("elixhauser_vanwalraven"))
