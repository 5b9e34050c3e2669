"""Nested JSON as metrics with dotted names.

Nesting is of any depth, so one level after another is unfolded as VARIANT
values with built-in functions, in one pass over the rows; the number of rounds
is the depth of the deepest document, which one aggregation finds beforehand
unless it is stated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Value, value


def leaf(raw: Column) -> Value:
    """A scalar's JSON text as a value: whole numbers as longs, others as doubles, null as empty."""
    text = F.when(F.startswith(raw, F.lit('"')), F.get(F.from_json(F.concat(F.lit("["), raw, F.lit("]")), "array<string>"), F.lit(0)))
    whole = F.when(raw.rlike(r"^-?[0-9]+$"), raw.try_cast("bigint"))
    real = F.when(raw.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$") & whole.isNull(), raw.try_cast("double"))
    truth = F.when(raw.isin("true", "false"), raw == "true")
    return value(bool=truth, int=whole, dbl=real, string=text)


def depth(df: DataFrame, column: str) -> int:
    """The deepest nesting: the most brackets open at once, strings aside."""
    bare = F.regexp_replace(F.col(column), r'"(?:[^"\\]|\\.)*+"', "")
    signs = F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), "")
    step = F.transform(signs, lambda c: F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0))
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    most = F.aggregate(step, zero, lambda a, x: F.struct((a["now"] + x).alias("now"), F.greatest(a["most"], a["now"] + x).alias("most")), lambda a: a["most"])
    return df.agg(F.max(most)).first()[0] or 0


def flatten(df: DataFrame, column: str, prefix: tuple[str, ...] = ("body",), levels: int | None = None) -> DataFrame:
    """Each row of ``df`` once a leaf, with metric (path) and kind, b, i, d, s.

    Array elements are named by their place. Texts that aren't JSON have no
    leaves; a null leaf is an empty value; objects and arrays without elements
    have none. With ``levels`` stated, rows are read once, so a stream will do;
    a document that nests deeper is an error.
    """
    names = [c for c in df.columns if c != column]
    out = df.withColumn("__v", F.try_parse_json(column)).filter("__v IS NOT NULL").withColumn("metric", F.array(*[F.lit(p) for p in prefix]).cast("array<string>"))
    children = F.expr("""CASE WHEN schema_of_variant(__v) LIKE 'OBJECT%'
        THEN transform(map_entries(variant_get(__v, '$', 'map<string,variant>')), e -> named_struct('k', e.key, 'v', e.value))
        WHEN schema_of_variant(__v) LIKE 'ARRAY%'
        THEN transform(variant_get(__v, '$', 'array<variant>'), (e, j) -> named_struct('k', cast(j AS string), 'v', e))
        ELSE array(named_struct('k', cast(null AS string), 'v', __v)) END""")
    for _ in range(depth(df.select(column), column) if levels is None else levels):
        out = out.select(*names, "metric", F.explode(children).alias("__c"))
        out = out.select(*names, F.when(F.col("__c.k").isNull(), F.col("metric")).otherwise(F.concat("metric", F.array("__c.k"))).alias("metric"), F.col("__c.v").alias("__v"))
    text = F.to_json("__v")
    if levels is not None:
        deeper = F.schema_of_variant("__v").rlike("^(OBJECT|ARRAY)")
        text = F.when(deeper, F.raise_error(F.lit(f"JSON nests deeper than {levels} levels"))).otherwise(text)
    return out.select(*names, "metric", text.alias("__t")).select(*names, "metric", *leaf(F.col("__t")).columns(["bool", "int", "dbl", "string"]))
