"""Declared rules over the customer table: repair, counts, failure rows, valid/rejected split."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsewatch import constants as K


@dataclass(frozen=True)
class Rule:
    """A named condition a column's value must meet; null passes all but ``not_null``."""

    column: str
    name: str
    holds: Column

    @property
    def broken(self) -> Column:
        if self.name == "not_null":
            return ~self.holds
        return F.col(self.column).isNotNull() & ~F.coalesce(self.holds, F.lit(False))


def rules_for(columns: Sequence[str]) -> list[Rule]:
    """The declared rules of the customer table, restricted to ``columns``."""
    checks = {c: ("allowed", F.col(c).isin(v)) for c, v in K.DOMAINS.items()}
    checks |= {
        "SeniorCitizen": ("allowed", F.col("SeniorCitizen").cast("string").isin("0", "1")),
        "tenure": ("range", F.col("tenure").between(0, 100)),
        "MonthlyCharges": ("positive", F.col("MonthlyCharges") > 0),
        "TotalCharges": ("not_negative", F.col("TotalCharges").try_cast("double") >= 0),
        "Churn": ("allowed", F.col("Churn").isin(K.YES_NO)),
    }
    rules = []
    for c in columns:
        rules.append(Rule(c, "not_null", F.col(c).isNotNull()))
        if c in checks:
            rules.append(Rule(c, *checks[c]))
    return rules


RAW_RULE_COLUMNS = K.RAW_COLUMNS
REQUEST_RULE_COLUMNS = K.REQUEST_COLUMNS


def trim_strings(df: DataFrame) -> DataFrame:
    """Strip blanks around every text value, in one projection."""
    return df.select(*[
        F.trim(F.col(f.name)).alias(f.name) if f.dataType.typeName() == "string"
        else F.col(f.name) for f in df.schema.fields
    ])


def repair_total_charges(df: DataFrame) -> DataFrame:
    """Blank or non-numeric totals take the monthly charge, as for a customer's first bill."""
    amount = F.nullif(F.trim("TotalCharges"), F.lit("")).try_cast("double") \
        if dict(df.dtypes)["TotalCharges"] == "string" else F.col("TotalCharges")
    return df.withColumn("TotalCharges", F.coalesce(amount, F.col("MonthlyCharges")))


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def violation_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Violations per declared rule, all rules in one pass; columns not declared are ignored."""
    rules = rules_for(columns)
    counts = df.agg(*[F.count_if(r.broken).alias(f"r{i}") for i, r in enumerate(rules)])
    rows = F.inline(F.array(*[
        F.struct(F.lit(r.column).alias("column_name"), F.lit(r.name).alias("rule"),
                 F.col(f"r{i}").alias("violations")) for i, r in enumerate(rules)
    ]))
    return counts.select(rows)


def validate(df: DataFrame, columns: Sequence[str] = RAW_RULE_COLUMNS) -> DataFrame:
    """Fail fast: raise on any violation, else hand the table on unchanged."""
    require_columns(df, columns)
    broken = violation_counts(df, columns).where("violations > 0").collect()
    if broken:
        found = ", ".join(f"{r.column_name}/{r.rule}: {r.violations}" for r in broken)
        raise ValueError(f"rules violated: {found}")
    return df


def failure_cases(df: DataFrame, columns: Sequence[str], key: str = "customerID") -> DataFrame:
    """Every failed check as a row: key, column, rule, offending value."""
    cases = F.filter(F.array(*[
        F.when(r.broken, F.struct(
            F.lit(r.column).alias("column_name"), F.lit(r.name).alias("rule"),
            F.col(r.column).cast("string").alias("failure_case")))
        for r in rules_for(columns)
    ]), lambda case: case.isNotNull())
    return df.select(key, F.inline(cases))


def validation_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: verdict, row count, column count and number of failure cases."""
    failed = sum((r.broken.cast("int") for r in rules_for(columns)), F.lit(0))
    return df.agg(
        (F.coalesce(F.sum(failed), F.lit(0)) == 0).alias("is_valid"),
        F.count(F.lit(1)).alias("row_count"),
        F.lit(len(df.columns)).alias("column_count"),
        F.coalesce(F.sum(failed), F.lit(0)).cast("bigint").alias("failure_count"),
    )


def meets_all(columns: Sequence[str]) -> Column:
    """True when no rule is broken; never null."""
    return ~reduce(or_, [r.broken for r in rules_for(columns)])


def reasons(columns: Sequence[str]) -> Column:
    """Names of the broken rules as a comma-separated text, empty for a good row."""
    return F.concat_ws(",", *[
        F.when(r.broken, F.lit(f"{r.column}:{r.name}")) for r in rules_for(columns)
    ])


def mark_rows(df: DataFrame, columns: Sequence[str] = REQUEST_RULE_COLUMNS) -> DataFrame:
    """Every row with its ``reasons`` and a ``status`` of valid or rejected, in one projection."""
    marked = df.withColumn("reasons", reasons(columns))
    return marked.withColumn(
        "status", F.when(F.col("reasons") == "", "valid").otherwise("rejected"))


def split_rows(df: DataFrame, columns: Sequence[str] = REQUEST_RULE_COLUMNS
               ) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with ``reasons``); a bad row never reaches the model."""
    good = meets_all(columns)
    return df.where(good), df.where(~good).withColumn("reasons", reasons(columns))


def implausible_total() -> Column:
    """Warning flag: billed far more than the tenure can explain."""
    ceiling = F.col("MonthlyCharges") * (F.col("tenure") + 1) * 1.5
    return (F.col("tenure") > 0) & (F.col("TotalCharges") > ceiling)


def blank_total_audit(df: DataFrame) -> DataFrame:
    """How many totals are blank, and whether all of them belong to brand-new customers."""
    blank = F.trim("TotalCharges") == ""
    return df.agg(
        F.count_if(blank).alias("blank_totals"),
        F.coalesce(F.bool_and(F.when(blank, F.col("tenure") == 0)), F.lit(True))
        .alias("all_blank_at_zero_tenure"),
    )


def contract_checks(df: DataFrame, rows: int | None = None, columns: int = len(K.RAW_COLUMNS),
                    churn_between: tuple[float, float] = (0.25, 0.28)) -> DataFrame:
    """One row of booleans a delivered table must satisfy; ``rows`` fixes the row count."""
    critical = ["customerID", "tenure", "MonthlyCharges", "Contract", "Churn"]
    rate = F.avg((F.col("Churn") == "Yes").cast("double"))
    count = F.count(F.lit(1))
    return df.agg(
        (count == rows if rows is not None else count > 0).alias("row_count_ok"),
        F.lit(len(df.columns) == columns).alias("column_count_ok"),
        ((rate > churn_between[0]) & (rate < churn_between[1])).alias("churn_rate_ok"),
        ((F.min("tenure") >= 0) & (F.max("tenure") <= 100)).alias("tenure_ok"),
        (F.count_if(F.greatest(*[F.col(c).isNull() for c in critical])) == 0)
        .alias("no_nulls_ok"),
    )
