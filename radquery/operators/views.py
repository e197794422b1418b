"""Lists, pages, searches and timelines over stored records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = 20


def page(df: DataFrame, order: list[Column], skip: int = 0, limit: int = PAGE) -> DataFrame:
    """A page of the ordered rows with the number of all rows. The order has to end with a key, so that pages are stable."""
    total = df.agg(F.count("*").alias("total"))  # one row
    return df.orderBy(*order).offset(skip).limit(limit).join(F.broadcast(total))


def listed(df: DataFrame, order: list[Column]) -> DataFrame:
    """All rows in order. Spark deals them out by ranges of the order, so no task gets all."""
    return df.orderBy(*order)


def contains_any(needle: str, *columns: Column) -> Column:
    """True where a column has the text in it, in any case; % and _ are plain characters, and null columns have nothing."""
    found = F.lit(needle == "")
    for c in columns:
        found = found | F.coalesce(F.contains(F.lower(c), F.lit(needle.lower())), F.lit(False))
    return found


def chosen(value: str, c: Column, everything: str = "all") -> Column:
    return F.lit(value == everything) | (c == value)


def timeline(patients: DataFrame, scans: DataFrame, details: DataFrame, patient: str, scan_patient: str, scan: str, detail_scan: str, when: str) -> DataFrame:
    """For each patient: scans, their details, and the last scan. Details are summed by scan before they meet patients."""
    each = details.groupBy(F.col(detail_scan).alias("_scan")).agg(F.count("*").alias("_n"))
    joined = scans.join(each, F.col(scan) == F.col("_scan"), "left")
    sums = joined.groupBy(F.col(scan_patient).alias("_patient")).agg(F.count("*").alias("scans"), F.sum(F.coalesce("_n", F.lit(0))).alias("details"), F.max(when).alias("last_scan"))
    out = patients.join(sums, F.col(patient) == F.col("_patient"), "left")
    return out.select(patient, F.coalesce("scans", F.lit(0)).alias("scans"), F.coalesce("details", F.lit(0)).alias("details"), "last_scan")


def initials(name: Column) -> Column:
    firsts = F.transform(F.split(name, " "), lambda w: F.substring(w, 1, 1))
    return F.upper(F.substring(F.array_join(firsts, ""), 1, 2))


def ellipsis(text: Column, most: int = 50) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)
