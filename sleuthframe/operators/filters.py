"""Selections, ordering and paging of investigation tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Weights of severities in the grid order, and accounts that are not people.
SEVERITY_WEIGHTS = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1}
SERVICE_ACCOUNTS = ("SYSTEM", "LOCAL SERVICE", "NETWORK SERVICE", "-")
USER_KEYS = ("TargetUserName", "SubjectUserName", "User", "AccountName")
MAX_PAGE = 200


def in_case(df: DataFrame, case_id, column: str = "case_id") -> DataFrame:
    return df.filter(F.col(column) == case_id)


def owned_by(df: DataFrame, user, column: str, role: str = "investigator") -> DataFrame:
    """Administrators and viewers see everything, others their own rows."""
    return df if role in ("admin", "viewer") else df.filter(F.col(column) == user)


def matches(term: str, *columns: str) -> Column:
    """Case-insensitive literal search: %, _ and \\ in the term mean themselves."""
    return reduce(lambda a, b: a | b, [F.contains(F.lower(F.col(c).cast("string")), F.lit(term.lower())) for c in columns])


def filter_artifacts(df: DataFrame, *, artifact_type=None, source=None, value_contains=None, extractor=None,
                     min_confidence=None, max_confidence=None, username=None, ip_address=None,
                     is_suspicious=None, date_from=None, date_to=None) -> DataFrame:
    """Only the given conditions apply."""
    tests = []
    if artifact_type is not None:
        tests.append(F.col("artifact_type") == artifact_type)
    if source is not None:
        tests.append(F.col("evidence_id") == source)
    tests += [matches(t, "value") for t in (value_contains, username, ip_address) if t]
    if extractor is not None:
        tests.append(F.col("extractor") == extractor)
    if min_confidence is not None:
        tests.append(F.col("confidence") >= min_confidence)
    if max_confidence is not None:
        tests.append(F.col("confidence") <= max_confidence)
    if is_suspicious is not None:
        tests.append(F.get_json_object("details", "$.is_suspicious") == str(is_suspicious).lower())
    if date_from is not None:
        tests.append(F.col("extracted_at") >= F.lit(date_from).cast("timestamp"))
    if date_to is not None:
        tests.append(F.col("extracted_at") <= F.lit(date_to).cast("timestamp"))
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


def json_equals(column: str, path: str, value: str) -> Column:
    return F.get_json_object(column, path) == value


def grid_filter(df: DataFrame, term: str = "", **column_terms: str) -> DataFrame:
    """A term anywhere in the row, and a term in each named column."""
    if term:
        row = F.concat_ws(" ", *[F.col(c).cast("string") for c in df.columns])
        df = df.filter(F.contains(F.lower(row), F.lit(term.lower())))
    for column, part in column_terms.items():
        df = df.filter(matches(part, column))
    return df


def grid_sort(df: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    """Severities by weight, numbers by value, other text in its own order.

    Equal values are ordered by a hash of the row, so that the sort can split a
    value that a third of the rows share.
    """
    text = F.trim(F.col(column).cast("string"))
    weight = F.create_map(*[F.lit(x) for kv in SEVERITY_WEIGHTS.items() for x in kv])[F.lower(text)]
    order = [F.coalesce(weight.cast("double"), text.try_cast("double")), F.lower(text), text]
    return df.orderBy(*[(c.asc_nulls_last() if ascending else c.desc_nulls_first()) for c in order], F.xxhash64(*df.columns))


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 50) -> DataFrame:
    """One page; the size is held between 1 and 200."""
    size, number = max(1, min(size, MAX_PAGE)), max(1, number)
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_totals(df: DataFrame, size: int = 50) -> DataFrame:
    size = max(1, min(size, MAX_PAGE))
    total = df.agg(F.count("*").alias("total"))
    return total.withColumn("total_pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long"))


def next_page(df: DataFrame, key: str, unique: str, after: tuple | None = None, size: int = 50) -> DataFrame:
    """Deep paging: rows below the last seen (key, unique), newest first, without skipping over earlier pages."""
    if after is not None:
        df = df.filter((F.col(key) < F.lit(after[0])) | ((F.col(key) == F.lit(after[0])) & (F.col(unique) < F.lit(after[1]))))
    return df.orderBy(F.col(key).desc(), F.col(unique).desc()).limit(max(1, min(size, MAX_PAGE)))


def log_users(records: DataFrame, data: str = "data") -> DataFrame:
    """Account names of event records, service accounts left out."""
    named = records.withColumn("user", F.explode(F.array(*[F.col(data)[k] for k in USER_KEYS])))
    return named.filter((F.col("user") != "") & ~F.col("user").isin(*SERVICE_ACCOUNTS))
