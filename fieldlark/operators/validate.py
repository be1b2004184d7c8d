"""Validation: checks, a gate that stops at once or lists every failure, keys and references."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F


class SchemaError(ValueError):
    """The first failure that a gate met."""


@dataclass(frozen=True)
class Check:
    """Rows where ``broken`` is true fail; null is no failure."""

    name: str
    broken: Column


@dataclass(frozen=True)
class Schema:
    """What a table should be: types, checks, a unique key, and no other column if strict."""

    types: dict[str, str]
    nullable: frozenset[str] = frozenset()
    checks: tuple[Check, ...] = ()
    unique: tuple[str, ...] = ()
    strict: bool = True
    columns: tuple[str, ...] = field(default=())

    def all_checks(self) -> list[Check]:
        return [*(not_null(c) for c in self.types if c not in self.nullable), *self.checks]


def not_null(column: str) -> Check:
    return Check(f"not_null({column})", F.col(column).isNull())


def isin(column: str, allowed) -> Check:
    return Check(f"isin({column})", ~F.col(column).isin(*sorted(allowed)))


def in_range(column: str, low, high) -> Check:
    return Check(f"in_range({column})", ~F.col(column).between(low, high))


def equal_to(column: str, value) -> Check:
    return Check(f"equal_to({column})", F.col(column) != value)


def schema_problems(df: DataFrame, schema: Schema) -> list[str]:
    """Missing columns, wrong types and, if strict, columns not declared."""
    have = dict(df.dtypes)
    out = [f"missing column {c}" for c in schema.types if c not in have]
    out += [f"{c} is {have[c]}, not {t}" for c, t in schema.types.items() if c in have and have[c] != t]
    return out + [f"column {c} is not declared" for c in have if schema.strict and c not in schema.types]


def failures(df: DataFrame, schema: Schema) -> DataFrame:
    """(columns of ``df``, check): a row for every check that a row fails, in one pass.

    Uniqueness counts its keys, nulls as equal, and fails every row of a
    repeated one: counts combine before the shuffle and only repeated keys are
    joined back, so a key of very many rows can be split.
    """
    checks, rows = schema.all_checks(), df
    if schema.unique:
        keys = [F.col(k).alias(f"_key{i}") for i, k in enumerate(schema.unique)]
        repeated = df.select(*keys).groupBy(*(f"_key{i}" for i in range(len(keys)))).agg(F.count("*").alias("_same")).where("_same > 1")
        same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(schema.unique)))
        rows = rows.join(repeated, same, "left")
        checks = [*checks, Check(f"unique({', '.join(schema.unique)})", F.col("_same").isNotNull())]
    found = F.array_compact(F.array(*(F.when(c.broken, F.lit(c.name)) for c in checks)))
    return rows.select(*df.columns, F.explode(found).alias("check"))


def failure_counts(df: DataFrame, schema: Schema) -> DataFrame:
    """(check, n), most failures first. A check without failures gives no row."""
    return failures(df, schema).groupBy("check").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "check")


def gate(df: DataFrame, schema: Schema, lazy: bool = False) -> DataFrame:
    """``df`` if it fits. Otherwise raises SchemaError at the first problem or, if ``lazy``, with the counts of all."""
    problems = schema_problems(df, schema)
    if problems:
        raise SchemaError("; ".join(problems))
    if lazy:
        counts = failure_counts(df, schema).collect()  # a row a check at most
        if counts:
            raise SchemaError("; ".join(f"{r['check']}: {r['n']}" for r in counts))
        return df
    first = failures(df, schema).limit(1).collect()
    if first:
        raise SchemaError(f"{first[0]['check']} fails for {first[0].asDict()}")
    return df


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Rows of ``child`` whose key ``parent`` lacks; null keys refer to nothing and pass."""
    known = parent.select(F.col(parent_key or key).alias(key)).distinct()
    return child.where(F.col(key).isNotNull()).join(known, key, "left_anti")


def referring(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Rows of ``child`` whose key ``parent`` has."""
    return child.join(parent.select(F.col(parent_key or key).alias(key)).distinct(), key, "left_semi")


def key_report(df: DataFrame, keys: list[str]) -> DataFrame:
    """(n_rows, n_keys, lost): rows that a candidate key would lose; zero for a key."""
    per = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").cast("long").alias("n_rows"), F.count("*").alias("n_keys"), (F.sum("n") - F.count("*")).cast("long").alias("lost"))


def contract_schema(types: dict[str, str], contract: DataFrame, ranges: dict[str, tuple[float, float]], statuses: set[str], clean: bool = False) -> Schema:
    """The schema of decoded telemetry, from the contract: tags, units, statuses, ranges and clocks.

    The contract is one row a tag, so its tags and units are read to the
    driver. A unit without a range raises. ``clean`` also asks for a value, a
    Good status and one row a measurement.
    """
    rows = contract.select("tag", "unit").collect()
    unknown = sorted({r["unit"] for r in rows} - set(ranges))
    if unknown:
        raise SchemaError(f"the contract declares a unit with no range: {unknown}")
    outside = F.lit(False)
    for unit, (low, high) in ranges.items():
        outside = outside | ((F.col("unit") == unit) & ~F.col("value").between(low, high))
    checks = [
        isin("tag", {r["tag"] for r in rows}),
        isin("unit", set(ranges)),
        equal_to("status", "Good") if clean else isin("status", statuses),
        in_range("seq", 0, 255),
        Check("value_inside_the_range_for_its_unit", F.col("value").isNotNull() & outside),
        Check("event_time_at_or_before_server_time", F.col("event_time") > F.col("server_time")),
    ]
    return Schema(types, frozenset() if clean else frozenset({"value"}), tuple(checks), ("tag", "event_time") if clean else ())
