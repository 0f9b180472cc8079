"""Which columns look like they hold personal data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veil.functions.canonical import ident, is_text

# A digit starts a match only if the character before it is no digit, and a match
# must not go on in a digit, so parts of longer numbers do not count.  Every
# pattern starts with the rarest character it can, which keeps the scan cheap.
_START, _END = "[0-9](?<![0-9][0-9])", "(?![0-9])"
PATTERNS = {
    "email": r"@(?<=[A-Za-z0-9._%+-]@)[A-Za-z0-9.-]+\.[A-Za-z][A-Za-z]",
    "phone": rf"(?:{_START}[0-9]{{2}}[-. ]|\((?<![0-9]\()[0-9]{{3}}\) ?)[0-9]{{3}}[-. ][0-9]{{4}}{_END}",
    "ssn": rf"{_START}[0-9]{{2}}-[0-9]{{2}}-[0-9]{{4}}{_END}",
    "card": rf"{_START}[0-9]{{3}}[- ]?[0-9]{{4}}[- ]?[0-9]{{4}}[- ]?[0-9]{{4}}{_END}",
    "date": rf"{_START}(?:[0-9]{{3}}-[0-9]{{1,2}}-[0-9]{{1,2}}|[0-9]?/[0-9]{{1,2}}/[0-9]{{4}}){_END}",
}
SUGGESTED = {
    "email": "anonymize_email",
    "phone": "anonymize_phone",
    "ssn": "anonymize_ssn",
    "card": "hash",
    "date": "generalize_date",
}


def detect_pii(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per text column and kind: values, values with a match and their share.

    All patterns of all columns are counted in a single aggregate.
    """
    texts = columns or [f.name for f in df.schema.fields if is_text(f.dataType)]
    found = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(kind).alias("kind"),
            F.count(ident(c)).alias("values"),
            F.count_if(ident(c).rlike(pattern)).alias("hits"),
        )
        for c in texts
        for kind, pattern in PATTERNS.items()
    ]
    if not found:
        schema = "column string, kind string, values bigint, hits bigint, share double"
        return df.sparkSession.createDataFrame([], schema)
    long = df.agg(F.array(*found).alias("s")).select(F.inline("s"))
    return long.withColumn("share", F.coalesce(F.try_divide("hits", "values"), F.lit(0.0)))


def suggest_policy(df: DataFrame, threshold: float = 0.5, columns: list[str] | None = None) -> dict:
    """A table policy for the columns of which enough values match a pattern.

    One row per column and kind comes to the driver, whatever the table's size.
    """
    policy: dict[str, tuple[float, str]] = {}
    for row in detect_pii(df, columns).filter(F.col("share") >= threshold).collect():
        best = policy.get(row["column"], (0.0, ""))
        policy[row["column"]] = max(best, (row["share"], SUGGESTED[row["kind"]]))
    return {column: method for column, (_, method) in policy.items()}
