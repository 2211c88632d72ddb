"""The registered queries opN_<name> and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import budget, cotrain, divergence, editwalk, feistel, jaccard, langmix, merkle, packing, templates
from .common import materialise

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = divergence.judge(table(spark, sf_dir, "documents"))
    return out.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


# No SQL for op1: its word limits come from samples of the references; tests hold it against plain loops.
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


#: Ids of records in a file of the audited archive, and the damage done to its second copy.
PAGES_A_FILE = 512


def archive(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two replicas of the pages as archive records (file, offset, content).

    A file holds PAGES_A_FILE ids; a record's offset is what the records before it in its file
    take. In the second replica one page in 97 has a character changed, one in 389 is lost, and
    one in 401 has a record more behind it.
    """
    content = F.concat_ws("\n", F.concat(F.lit("WARC-Target-URI: "), F.coalesce("url", F.lit(""))), F.coalesce("html", F.lit("")))
    rows = pages.select("page_id", F.concat(F.lit("part-"), F.expr(f"page_id div {PAGES_A_FILE}")).alias("file"), content.alias("content"))
    before = Window.partitionBy("file").orderBy("page_id").rowsBetween(Window.unboundedPreceding, -1)  # PAGES_A_FILE rows at most
    first = rows.withColumn("offset", F.coalesce(F.sum(F.octet_length("content").cast("long")).over(before), F.lit(0).cast("long")))
    changed = F.concat(F.expr("left(content, length(content) div 2)"), F.lit("#"), F.expr("substr(content, length(content) div 2 + 2)"))
    second = first.where("page_id % 389 <> 7").withColumn("content", F.when(F.expr("page_id % 97 = 3"), changed).otherwise(F.col("content")))
    extra = first.where("page_id % 401 = 5").select("page_id", "file", F.lit("extra").alias("content"), F.expr("offset + 1").alias("offset"))
    return first, second.unionByName(extra)


@query
def op2_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = archive(table(spark, sf_dir, "pages"))
    return merkle.audit(first, second)


ORACLES["op2_merkle"] = f"""
WITH p AS (
  SELECT page_id, 'part-' || (page_id // {PAGES_A_FILE}) AS file, 'WARC-Target-URI: ' || coalesce(url, '') || chr(10) || coalesce(html, '') AS content FROM pages),
a AS (
  SELECT *, coalesce(sum(octet_length(encode(content))) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM p),
b AS (
  SELECT file, "offset", CASE WHEN page_id % 97 = 3 THEN left(content, length(content) // 2) || '#' || substr(content, length(content) // 2 + 2) ELSE content END AS content
  FROM a WHERE page_id % 389 <> 7
  UNION ALL SELECT file, "offset" + 1, 'extra' FROM a WHERE page_id % 401 = 5),
x AS (SELECT file, "offset", sha256('record ' || "offset" || chr(10) || content) AS d FROM a),
y AS (SELECT file, "offset", sha256('record ' || "offset" || chr(10) || content) AS d FROM b)
SELECT file, "offset", CASE WHEN y.d IS NULL THEN 'missing' WHEN x.d IS NULL THEN 'extra' ELSE 'changed' END AS status, x.d AS first_digest, y.d AS second_digest
FROM x FULL JOIN y USING (file, "offset") WHERE x.d IS DISTINCT FROM y.d
"""


@query
def op3_editwalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editwalk.compare_with_next(table(spark, sf_dir, "documents"))


@query
def op3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other half of op3: classes of documents whose fingerprints share a band and are verified."""
    prints = materialise(op3_editwalk(spark, sf_dir).select("doc_id", "fingerprint"), "prints")
    return editwalk.near_classes(prints)


@query
def op4_cotrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = cotrain.classify(docs, cotrain.train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.col("quality_score").alias("score"), F.col("quality_kept").alias("kept"))


@query
def op5_langmix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = "coalesce(crc32(cast(doc_id as string)) % 3 = 1, false)"
    model = langmix.fit(docs.where(f"not {held_out}"))
    return langmix.predict(docs, model).withColumn("held_out", F.expr(held_out)).select("doc_id", "held_out", "lang_pred", "score", "langs", "shares")


@query
def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_components(table(spark, sf_dir, "documents"))


ORACLES["op6_jaccard"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w
  FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g
  FROM w, unnest(range(1, greatest(len(w) - 3, 2))) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""


#: Key of the registered query only; callers bring their own.
KEY = b"emberplan pseudonyms"


@query
def op7_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = feistel.pseudonymise(table(spark, sf_dir, "documents"), KEY)
    return out.select("doc_id", "text", *[f"n_{k}" for k in feistel.KINDS])


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op9_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = templates.drop_templates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars_kept"), F.sha2("text", 256).alias("kept_sha256"))


ORACLES["op9_templates"] = rf"""
WITH RECURSIVE d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, ls[i] AS x FROM d, unnest(range(1, len(ls) + 1)) AS t(i) WHERE i < len(ls) OR ls[i] <> ''),
t AS (SELECT doc_id, i, x, list_transform(list_filter(regexp_split_to_array(x, '[ \t\n\x0B\f\r]+'), lambda y: y <> ''), lambda y: CASE WHEN regexp_matches(y, '[0-9]') THEN '<*>' ELSE y END) AS w FROM l),
-- (leaf, place, token) of at least {templates.MIN_DOCS} documents; templates of the lines that have enough constants
tok AS (SELECT doc_id, i, len(w) AS n, w[1:{templates.DEPTH}] AS lead, p, w[p] AS y FROM t, unnest(range(1, len(w) + 1)) AS u(p)),
con AS (SELECT n, lead, p, y FROM tok WHERE p > {templates.DEPTH} GROUP BY ALL HAVING count(DISTINCT doc_id) >= {templates.MIN_DOCS}),
tpl AS (SELECT doc_id, i, list(CASE WHEN tok.p <= {templates.DEPTH} OR con.p IS NOT NULL THEN tok.y ELSE '<*>' END ORDER BY tok.p) AS v
        FROM tok LEFT JOIN con ON con.n = tok.n AND con.lead = tok.lead AND con.p = tok.p AND con.y = tok.y GROUP BY doc_id, i),
v AS (SELECT doc_id, i, v, md5(text) AS h FROM tpl JOIN d USING (doc_id) WHERE 100 * len(list_filter(v, lambda y: y <> '<*>')) >= {templates.SIMILAR} * len(v)),
r0 AS (SELECT v FROM v GROUP BY v HAVING count(DISTINCT h) >= {templates.MIN_DOCS}),
-- near copies among the texts that would lose over half their words
over AS (SELECT v.h FROM v SEMI JOIN r0 USING (v) JOIN t USING (doc_id, i) JOIN (SELECT doc_id, sum(len(w)) AS n FROM t GROUP BY doc_id) s USING (doc_id)
         GROUP BY v.doc_id, v.h, s.n HAVING 2 * sum(len(w)) > s.n),
ow AS (SELECT DISTINCT md5(text) AS h, list_filter(regexp_split_to_array(translate(text, {_LOWER}), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents WHERE md5(text) IN (SELECT h FROM over)),
g AS (SELECT DISTINCT h, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM ow, unnest(range(1, greatest(len(w) - 3, 2))) AS u(i) WHERE len(w) > 0),
n AS (SELECT h, count(*) AS n FROM g GROUP BY h),
p AS (SELECT a.h AS a, b.h AS b, count(*) AS shared FROM g a JOIN g b ON a.g = b.g AND a.h <> b.h GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.h = a JOIN n y ON y.h = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
cc AS (SELECT h AS a, h AS b FROM n UNION SELECT cc.a, e.b FROM cc JOIN e ON cc.b = e.a),
cl AS (SELECT a AS h, min(b) AS c FROM cc GROUP BY a),
r AS (SELECT v FROM v SEMI JOIN r0 USING (v) LEFT JOIN cl USING (h) GROUP BY v HAVING count(DISTINCT coalesce(c, h)) >= {templates.MIN_DOCS}),
hit AS (SELECT DISTINCT doc_id, i FROM v SEMI JOIN r USING (v)),
k AS (SELECT t.doc_id, t.i, t.x, hit.i IS NOT NULL AS hit FROM t LEFT JOIN hit USING (doc_id, i)),
q AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (hit) AS n_dropped, string_agg(x, chr(10) ORDER BY i) FILTER (NOT hit) AS kept, max(i) AS last, arg_max(hit, i) AS last_hit FROM k GROUP BY doc_id),
o AS (SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped,
        CASE WHEN d.text IS NULL THEN NULL WHEN coalesce(n_dropped, 0) = 0 THEN d.text ELSE coalesce(kept, '') || CASE WHEN NOT last_hit AND len(ls) > last THEN chr(10) ELSE '' END END AS new
      FROM d LEFT JOIN q USING (doc_id))
SELECT doc_id, n_lines, n_dropped, CAST(length(new) AS BIGINT) AS n_chars_kept, sha256(new) AS kept_sha256 FROM o
"""


#: The domain of a source, by its number; languages of a domain, then sources of a language.
LEVELS = {"domain": "concat('d', cast(try_cast(regexp_extract(source, '([0-9]+)$', 1) as int) % 3 as string))", "lang": "lang", "source": "source"}
#: Target weights by path from the root; paths that aren't named weigh 1.
WEIGHTS = {("d0",): 3.0, ("d1",): 2.0, ("d2",): 1.0} | {(d, lang): w for d in ("d0", "d1", "d2") for lang, w in (("en", 4.0), ("de", 2.0), ("fr", 2.0), ("es", 1.0))}


@query
def op10_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = budget.mix(table(spark, sf_dir, "documents"), LEVELS, WEIGHTS, fraction=0.8, max_epochs=2)
    return out.select("doc_id", "lang", "source", F.col("mix_epoch").alias("epoch"), F.col("mix_tokens").alias("tokens"), F.col("mix_budget").alias("leaf_budget"))
