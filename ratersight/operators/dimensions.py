"""Sessions with what is known of their patients and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratersight.operators import tables
from ratersight.sources.files import part


def load_sessions(patients: DataFrame, sessions: DataFrame, reports: DataFrame, kind: str = "RA", order: tuple[str, ...] = ("path",)) -> DataFrame:
    """patients (patient, ...) with their sessions (patient, session, date, ...) and reports (subject_id, interview_type,
    path, ...): one row a session, and visit_no, the dense rank of its date within the patient.

    Only reports of one kind count; a report's session is the second-last part of its path, and of several reports of one
    session the first in `order` counts. Columns that several tables have are those of the leftmost one. Visits are
    numbered before rows without a session go, so a dated visit without a session has a number too."""
    own = reports.filter(F.col("interview_type") == kind).withColumnRenamed("subject_id", "patient").withColumn("session", part(F.col("path"), 2))
    own = tables.keep_first(own.filter("patient is not null and session is not null"), ["patient", "session"], list(order))
    out = tables.left_preferred(tables.left_preferred(patients, sessions, ["patient"]), own, ["patient", "session"])
    return out.withColumn("visit_no", tables.visit_number("patient", "date")).filter("session is not null")


def labelled(texts: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """texts (session, text) with the first label of their session, of those whose label is a whole number and whose text
    is not blank. labels has an explicit `place` that tells the first."""
    first = tables.keep_first(labels, ["session"], ["place"]).select("session", F.col(label).try_cast("int").alias("label"))
    return texts.filter(F.trim("text") != "").join(first.filter("label is not null"), "session")
