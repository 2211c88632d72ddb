"""Page classes and routes, tables, recognition attempts, top choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GARBAGE = "[�\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]"
ROUTES = {"NATIVE_TEXT": "vector", "IMAGE_ONLY": "scanned", "SCANNED": "scanned", "MIXED": "mixed", "POOR_TEXT": "mixed"}


def signals(text, width, height) -> list[Column]:
    """Text length, garbage share, characters for each 1000 square points."""
    n = F.length(text)
    return [n.alias("text_len"), F.when(n > 0, F.regexp_count(text, F.lit(GARBAGE)) / n).otherwise(0.0).alias("garbage_ratio"), F.coalesce(F.try_divide(n, width * height) * 1000, F.lit(0.0)).alias("text_density")]


def page_class(text_len, garbage, paths, images) -> Column:
    return F.when((text_len > 0) & (garbage > 0.15), "POOR_TEXT").when(text_len >= 10, "NATIVE_TEXT").when(paths >= 200, "MIXED").when(images > 0, "IMAGE_ONLY").otherwise("SCANNED")


def route(cls) -> Column:
    out = F.lit("scanned")
    for k, v in ROUTES.items():
        out = F.when(cls == k, v).otherwise(out)
    return out


def document_type(pages: DataFrame) -> DataFrame:
    """pages (doc_id, route): vector if at least as many pages carry text as don't."""
    text = F.count_if(F.col("route").isin("vector", "mixed"))
    return pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.when(text >= F.count_if(~F.col("route").isin("vector", "mixed")), "vector_pdf").otherwise("scanned_pdf").alias("doc_type"))


def quality(score) -> Column:
    return F.when(score >= 0.90, "GOOD").when(score >= 0.75, "REVIEW").otherwise("BAD")


def file_route(name, magic) -> Column:
    """By magic bytes or extension: what a file is to be read as."""
    ext = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    return F.when((ext == ".pdf") | (F.substring(magic, 1, 5) == "%PDF-"), "pdf").when((ext == ".dwg") | (F.substring(magic, 1, 2) == "AC"), "dwg").when(ext == ".dxf", "dxf").when(ext.isin(".png", ".jpg", ".jpeg"), "image").otherwise("unsupported")


def log_level(quality) -> Column:
    return F.when(quality == "BAD", "warning").when(quality == "REVIEW", "info").otherwise("debug")


def table_figures(rows) -> tuple[Column, Column]:
    """Cells (rows by the widest row) and the share of cells that hold something."""
    widest = F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))
    cells = F.size(rows) * widest
    full = F.size(F.filter(F.flatten(rows), lambda c: F.coalesce(F.trim(c), F.lit("")) != ""))
    return cells, F.coalesce(F.try_divide(full, cells), F.lit(0.0))


def table_passes(rows) -> Column:
    cells, ratio = table_figures(rows)
    return cells.between(2, 2000) & (ratio >= 0.35)


def markdown(rows) -> Column:
    """A table in Markdown: cells escaped, rows filled to the widest, the first one as header."""
    widest = F.array_max(F.transform(rows, F.size))
    cell = lambda c: F.replace(F.replace(F.trim(F.coalesce(c, F.lit(""))), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(0), widest - 1), lambda i: cell(F.get(r, i))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), widest), " | "), F.lit(" |"))
    body = F.transform(rows, line)
    return F.array_join(F.concat(F.slice(body, 1, 1), F.array(rule), F.slice(body, F.lit(2), F.greatest(F.size(body) - 1, F.lit(0)))), "\n")


def floor_areas_of_table(rows, labels: list[str]) -> Column:
    """ARRAY<STRUCT<label, value>> of a floor-area table's rows; empty for any other table."""
    low, high = 5.0, 100000.0
    header = F.array_join(F.transform(F.get(rows, F.lit(0)), lambda c: F.coalesce(c, F.lit(""))), " ")
    like = lambda t, p: F.regexp_like(t, F.lit("(?i)" + p))
    label_any = "|".join(f"(?:{p})" for p in labels)
    is_one = like(header, "AREA") & like(header, r"SQ\.?\s*M|SQM|M\s*2\b|M²") & (like(header, "FLOOR|STOREY|STORY|LEVEL") | like(header, label_any))

    def row(r):
        text = F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), " ")
        label = F.coalesce(*[F.nullif(F.regexp_extract(text, "(?i)" + p, 0), F.lit("")) for p in labels])
        numbers = F.transform(r, lambda c: F.regexp_extract(F.coalesce(c, F.lit("")), r"(\d+\.?\d*)", 1).try_cast("double"))
        value = F.get(F.filter(numbers, lambda v: v.between(low, high)), F.lit(0))
        return F.struct(F.upper(F.regexp_replace(F.trim(label), r"\s+", " ")).alias("label"), value.alias("value"))

    found = F.filter(F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), row), lambda x: x["label"].isNotNull() & x["value"].isNotNull())
    return F.when(is_one, found).otherwise(F.filter(found, lambda _: F.lit(False)))


def ocr_score(words: str, confidence: str, failed: str) -> Column:
    """Mean confidence, clamped, times the share of words with a letter or digit; 0 for none."""
    n = F.size(words)
    garbage = F.when(n > 0, F.size(F.filter(words, lambda w: ~F.regexp_like(w, F.lit("[0-9A-Za-z]")))) / n).otherwise(1.0)
    return F.when(F.col(failed) | (n <= 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.col(confidence), F.lit(100.0)) / 100) * (1 - garbage))


def best_attempt(attempts: DataFrame, good: float = 0.90) -> DataFrame:
    """attempts (id, ordinal, config, score): the best of those up to the first good one.

    Ties go to the earlier attempt. An id has a handful of attempts.
    """
    w = Window.partitionBy("id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    made = attempts.withColumn("before", F.coalesce(F.sum((F.col("score") >= good).cast("int")).over(w), F.lit(0))).where("before = 0")
    best = F.max_by(F.struct("config", "score"), F.struct("score", -F.col("ordinal")))
    return made.groupBy("id").agg(best.alias("b"), F.count("*").alias("attempts")).select("id", "b.config", "b.score", quality(F.col("b.score")).alias("quality"), "attempts")


def top_k(rows: DataFrame, by: str, order: list, k: int) -> DataFrame:
    """The first k rows of each group; Spark limits groups before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def largest_label(words: DataFrame) -> DataFrame:
    """words (page, ordinal, label, size): the label in the largest type, ties to the first."""
    return words.groupBy("page").agg(F.max_by("label", F.struct("size", -F.col("ordinal"))).alias("label"))
