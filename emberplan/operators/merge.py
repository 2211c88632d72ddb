"""Sources merged by field, fields graded by source, documents scored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GREEN = ("text_label", "dxf_text", "dxf_geometry", "table_native")


def merge(first: DataFrame, second: DataFrame, key: str, scalars: list[str], lists: list[str], sets: list[str]) -> DataFrame:
    """Scalars of the first source, where it has none of the second; lists one after the other;
    sets united and sorted; <scalar>_source tells whose a value is. Rows of either source stay."""
    b = second.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in scalars + lists + sets])
    j = first.join(b, F.col(key) == F.col("_k"), "full")
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(first.schema[c.lstrip("_")].dataType))
    return j.select(
        F.coalesce(key, "_k").alias(key),
        *[F.coalesce(c, f"_{c}").alias(c) for c in scalars],
        *[F.when(F.col(c).isNotNull(), "first").when(F.col(f"_{c}").isNotNull(), "second").alias(f"{c}_source") for c in scalars],
        *[F.concat(empty(c), empty(f"_{c}")).alias(c) for c in lists],
        *[F.array_sort(F.array_union(empty(c), empty(f"_{c}"))).alias(c) for c in sets],
    )


def first_of_pages(pages: DataFrame, key: str, page: str, scalars: list[str], lists: list[str]) -> DataFrame:
    """The value of the first page that has one; lists in page order."""
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(page))).alias(c) for c in scalars]
    joined = [F.flatten(F.array_sort(F.collect_list(F.struct(page, c)))[c]).alias(c) for c in lists]
    return pages.groupBy(key).agg(*first, *joined)


def grade(value, source) -> Column:
    """green for text of the drawing itself, amber for what was recognised, red for nothing."""
    return F.when(value.isNull(), "red").when(source.isin(*GREEN), "green").otherwise("amber")


def fields(docs: DataFrame, names: list[str]) -> DataFrame:
    """(doc_id, ordinal, field, value, source, confidence): a row for each form field.

    docs has <name> and <name>_source. The status is never derivable from a drawing; occupancy
    and construction are keyword guesses and so amber at best.
    """
    guess = ("occupancy", "construction_type")
    made = [
        F.struct(
            F.lit(i).alias("ordinal"),
            F.lit(n).alias("field"),
            F.col(n).cast("string").alias("value"),
            F.coalesce(F.col(f"{n}_source"), F.lit("")).alias("source"),
            (F.when(F.col(n).isNotNull(), "amber").otherwise("red") if n in guess else grade(F.col(n), F.col(f"{n}_source"))).alias("confidence"),
        )
        for i, n in enumerate(names)
    ]
    status = F.struct(F.lit(len(names)).alias("ordinal"), F.lit("building_status").alias("field"), F.lit(None).cast("string").alias("value"), F.lit("not_applicable").alias("source"), F.lit("red").alias("confidence"))
    return docs.select("doc_id", F.inline(F.array(*made, status)))


def floor_fields(docs: DataFrame, areas: str = "areas", most: int = 20) -> DataFrame:
    """(doc_id, floor_label, value) of the areas that are no basement's: GF, F1, ... by place."""
    kept = F.slice(F.filter(areas, lambda a: a["label"] != "basement_area"), 1, most)
    rows = docs.select("doc_id", F.posexplode(kept).alias("i", "a"))
    return rows.select("doc_id", F.when(F.col("i") == 0, "GF").otherwise(F.concat(F.lit("F"), F.col("i").cast("string"))).alias("floor_label"), F.col("a.value").alias("value"))


def quality(graded: DataFrame) -> DataFrame:
    """graded (doc_id, confidence): counts, score (half to even) and band."""
    n = {c: F.count_if(F.col("confidence") == c) for c in ("green", "amber", "red")}
    agg = graded.groupBy("doc_id").agg(*[v.alias(k) for k, v in n.items()])
    total = F.greatest(F.lit(1), F.col("green") + F.col("amber") + F.col("red"))
    summary = F.when(F.col("green") > F.col("red"), "good").when(F.col("amber") > F.col("red"), "partial").otherwise("minimal")
    return agg.withColumn("score", F.bround((F.col("green") * 100 + F.col("amber") * 50) / total, 0).cast("int")).withColumn("summary", summary)


def drawing_form(docs: DataFrame, fields: list[tuple[str, Column, str]], stage: str) -> DataFrame:
    """(doc_id, ordinal, field, value, source, confidence): the form that a drawing's text fills in.

    A field's kind says how far it is trusted: "text" is green, a keyword's "guess" and what only
    the "stage" vouches for are amber, "never" is not derivable. What is missing is red.
    """

    def one(i: int, name: str, value: Column, kind: str) -> Column:
        has = value.isNotNull()
        source = {"text": F.when(has, "text_label").otherwise(stage), "guess": F.when(has, "text_label").otherwise(""), "stage": F.lit(stage), "never": F.lit("not_applicable")}[kind]
        confidence = F.when(~has, "red").otherwise("green" if kind == "text" else "amber")
        return F.struct(F.lit(i).alias("ordinal"), F.lit(name).alias("field"), value.cast("string").alias("value"), source.alias("source"), confidence.alias("confidence"))

    return docs.select("doc_id", F.inline(F.array(*[one(i, *f) for i, f in enumerate(fields)])))
