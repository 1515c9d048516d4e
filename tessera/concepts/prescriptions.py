"""Prescriptions of a class of drugs, told by the drug's name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.compat import matches_any

# Parts of names, in any case.
ACE_INHIBITORS = ("BENAZEPRIL", "CAPTOPRIL", "ENALAPRIL", "FOSINOPRIL", "LISINOPRIL", "MOEXIPRIL", "PERINDOPRIL", "QUINAPRIL", "RAMIPRIL", "TRANDOLAPRIL")
NSAIDS = (
    "ASPIRIN", "BROMFENAC", "CELECOXIB", "DICLOFENAC", "DIFLUNISAL", "ETODOLAC", "FENOPROFEN", "FLURBIPROFEN", "IBUPROFEN", "INDOMETHACIN", "KETOPROFEN", "MEFENAMIC ACID", "MELOXICAM",
    "NABUMETONE", "NAPROXEN", "NEPAFENAC", "OXAPROZIN", "PIROXICAM", "SULINDAC", "TOLMETIN",
)


def _of_class(prescriptions: DataFrame, terms: tuple[str, ...], name: str) -> DataFrame:
    """A filter on the scan; the drug's own name says enough, so nothing is joined."""
    return prescriptions.where(matches_any(F.col("drug"), terms)).select("subject_id", "hadm_id", F.col("drug").alias(name), "starttime", "stoptime")


def acei(prescriptions: DataFrame) -> DataFrame:
    return _of_class(prescriptions, ACE_INHIBITORS, "acei")


def nsaid(prescriptions: DataFrame) -> DataFrame:
    return _of_class(prescriptions, NSAIDS, "nsaid")
