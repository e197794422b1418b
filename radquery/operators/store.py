"""Stored records: validation, keys, appends, latest versions, defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from radquery.functions import dims

#: Fixed values.
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
GENDERS = ("Male", "Female", "Other")
MIME_TYPES = ("image/jpeg", "image/png", "image/bmp", "image/tiff", "image/webp")
MAX_UPLOAD = 10 * 1024 * 1024
DEFAULT_PATIENT = dims.DEFAULT_PATIENT["patient_id"]


def blank_to_null(c: Column) -> Column:
    return F.when(~c.rlike(r"^\s*$"), c)


def patient_violations(name: Column, age: Column, gender: Column, email: Column) -> Column:
    """Names of the fields that break a rule, in this order. A null email is fine, and other nulls aren't."""
    fine = {
        "name": F.length(name).between(1, 100),
        "age": age.between(0, 150),
        "gender": gender.isin(*GENDERS),
        "email": email.isNull() | ((F.length(email) <= 100) & email.rlike(EMAIL)),
    }
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), field) for field, ok in fine.items())))


def upload_code(mime: Column, size: Column) -> Column:
    """200, or 400 for a wrong type, or 413 for too many bytes; the type is looked at first."""
    return F.when(~mime.isin(*MIME_TYPES) | mime.isNull(), 400).when(size > MAX_UPLOAD, 413).otherwise(200)


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def missing_parents(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    return child.join(parent.select(F.col(parent_key).alias("_parent")), F.col(key) == F.col("_parent"), "left_anti")


def with_default(records: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """Adds ``resolved``: the key as text, DEFAULT where it is null, and null where no such record is known."""
    ids = known.select(F.col(known_key).alias("_known")).distinct()
    joined = records.join(ids, F.col(key) == F.col("_known"), "left")
    return joined.withColumn("resolved", F.when(F.col(key).isNull(), DEFAULT_PATIENT).otherwise(F.col("_known").cast("string"))).drop("_known")


def missing_default(patients: DataFrame) -> DataFrame:
    """The record that stands for no patient (patient_id, name, age, gender), to be appended; no row where it is there already."""
    row = patients.sparkSession.createDataFrame([(*dims.DEFAULT_PATIENT.values(),)], "patient_id string, name string, age int, gender string")
    return row.join(patients.where(F.col("patient_id") == DEFAULT_PATIENT).select("patient_id").limit(1), "patient_id", "left_anti")


def one_or_none(df: DataFrame, key: str, value) -> Row | None:
    """The row with this key, if there is one. Several are an error; no more than two rows come to the driver."""
    rows = df.where(F.col(key) == F.lit(value)).limit(2).collect()
    if len(rows) > 1:
        raise ValueError(f"several rows have {key} = {value!r}")
    return rows[0] if rows else None


def exactly_one(df: DataFrame, key: str, value) -> Row:
    found = one_or_none(df, key, value)
    if found is None:
        raise LookupError(f"no row has {key} = {value!r}")
    return found


def latest(versions: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """For each key the newest version, by partial aggregation; a field that a version didn't supply keeps its value.

    ``supplied`` lists the fields of a version, so that a null that was supplied differs from none.
    """
    when = F.struct(*order)
    newest = {f: F.max_by(F.struct(F.col(f)), F.when(F.array_contains("supplied", f), when)) for f in fields}
    return versions.groupBy(key).agg(*(c[f].alias(f) for f, c in newest.items()), F.max(when).alias("version"))


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
