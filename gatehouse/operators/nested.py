"""Comparing nested documents leaf by leaf."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-6


def nesting(document: Column) -> Column:
    """How deep the containers of a variant lie in each other: 0 for a scalar, counted by the brackets of its JSON."""
    bare = F.regexp_replace(F.regexp_replace(F.to_json(document), r'"(\\.|[^"\\])*"', ""), r"[^\[\]{}]", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc: Column, c: Column) -> Column:
        now = acc["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(F.split(bare, ""), start, step, lambda acc: acc["most"])


def leaves(df: DataFrame, keep: list[str], variant: str) -> DataFrame:
    """(``keep``, path, leaf): a row for each scalar, null or empty container of a variant column.

    One aggregate tells how deep the documents go; each level is then one projection that opens what is still a container,
    so no document is walked in one value."""
    depth = df.agg(F.max(nesting(F.col(variant)))).first()[0] or 0
    rows, out = df.select(*keep, F.lit("$").alias("path"), F.col(variant).alias("leaf")), None
    for level in range(depth + 1):
        kind = F.schema_of_variant("leaf")
        entries = F.map_entries(F.try_variant_get("leaf", "$", "map<string,variant>"))
        items = F.try_variant_get("leaf", "$", "array<variant>")
        inside = F.when(kind.startswith("OBJECT<"), F.transform(entries, lambda e: F.struct(F.concat("path", F.lit("."), e["key"]).alias("path"), e["value"].alias("leaf"))))
        inside = inside.when(kind.startswith("ARRAY<"), F.transform(items, lambda x, i: F.struct(F.concat("path", F.lit("["), i.cast("string"), F.lit("]")).alias("path"), x.alias("leaf"))))
        opened = F.coalesce(F.size(inside), F.lit(0)) > 0
        flat = rows.where(~opened)
        out = flat if out is None else out.unionByName(flat)
        if level < depth:
            rows = rows.where(opened).select(*keep, F.inline(inside))
    return out


def spelt(leaf: str) -> Column:
    return F.to_json(F.col(leaf))


def compare(observed: DataFrame, expected: DataFrame, keep: list[str], variant: str, tolerance: float = TOLERANCE) -> DataFrame:
    """(``keep``, path, status, observed, expected): each leaf of two tables of documents that share ``keep``.

    ``equal``; ``close``, if the expected one has a fraction and the numbers differ by no more than the tolerance;
    ``differs``; ``missing`` from the observed document; ``extra`` in it.  Lists of other lengths have missing or extra
    items."""
    side = lambda df, name: leaves(df, keep, variant).select(*[F.col(c).alias(f"{c}_{name}") for c in keep], F.col("path").alias(f"path_{name}"), F.col("leaf").alias(name))
    a, b = side(observed, "observed"), side(expected, "expected")
    same = F.col("path_observed") == F.col("path_expected")
    for c in keep:
        same = same & F.col(f"{c}_observed").eqNullSafe(F.col(f"{c}_expected"))
    met = a.join(b, same, "full")
    number = lambda c: F.try_variant_get(c, "$", "double")
    numeric = lambda c: F.schema_of_variant(c).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    real = F.schema_of_variant("expected").rlike("^(DECIMAL|DOUBLE|FLOAT)")
    close = real & numeric("observed") & (F.abs(number("observed") - number("expected")) <= tolerance)
    equal = (spelt("observed") == spelt("expected")) | (numeric("observed") & numeric("expected") & (number("observed") == number("expected")))
    status = F.when(F.col("path_observed").isNull(), "missing").when(F.col("path_expected").isNull(), "extra").when(equal, "equal").when(close, "close").otherwise("differs")
    return met.select(*[F.coalesce(f"{c}_observed", f"{c}_expected").alias(c) for c in keep], F.coalesce("path_observed", "path_expected").alias("path"), status.alias("status"), spelt("observed").alias("observed"), spelt("expected").alias("expected"))


def verdicts(compared: DataFrame, keep: list[str]) -> DataFrame:
    """(``keep``, passed, mismatches): whether all expected leaves are met, and the paths of those that are not, in order;
    what is extra inside a list counts, other extra leaves do not."""
    bad = F.col("status").isin("differs", "missing") | (F.col("status") == "extra") & F.col("path").rlike(r"\[[0-9]+\][^\[]*$")
    found = F.array_sort(F.collect_list(F.when(bad, F.col("path"))))
    return compared.groupBy(*keep).agg(found.alias("mismatches")).withColumn("passed", F.size("mismatches") == 0)
