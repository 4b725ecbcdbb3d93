"""Taxonomies, counts, shares, quantiles, samples: the reporting queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import measures as M
from ..operators import ordering, sampling
from ..operators import taxonomy as T
from .base import FRAME, frame, query, r9, table

_TAX = FRAME + """, t AS (SELECT *, CASE WHEN duplicates >= 6 THEN 'recitation' WHEN templating <> 0 THEN 'reconstruction' ELSE 'recollection' END AS taxonomy,
  CASE WHEN nl_score <= 0.4 THEN 'Code' WHEN nl_score >= 0.525 THEN 'NL' ELSE 'Uncertain' END AS code_type FROM frame)"""


def _tax(spark, sf):
    return frame(spark, sf).withColumns({"taxonomy": T.memorization_taxonomy(F.col("duplicates"), F.col("templating")), "code_type": T.code_type(F.col("nl_score"))})


@query(f"""WITH {_TAX} SELECT id, taxonomy, label::VARCHAR || taxonomy AS stratum, CASE WHEN score < 0.9 THEN 'Not Memorized' WHEN duplicates > 5 THEN 'Recite' WHEN templating <> 0 THEN 'Reconstruct' ELSE 'Recollect' END AS category,
  CASE WHEN duplicates > 10 THEN 'recitation' WHEN templating <> 0 THEN 'reconstruction' ELSE 'recollection' END AS strict_taxonomy,
  CASE WHEN length >= 1000 THEN 'taxonomy_1' WHEN duplicates >= 7 THEN 'taxonomy_2' ELSE 'taxonomy_3' END AS pair FROM t""")
def taxonomy_labels(spark, sf):
    d, m = F.col("duplicates"), F.col("templating")
    scaled = F.when(F.col("score") >= 0.9, 1.0).otherwise(0.0)
    return _tax(spark, sf).select(
        "id",
        "taxonomy",
        T.stratify_key(F.col("label"), F.col("taxonomy")).alias("stratum"),
        T.report_category(scaled, d, m).alias("category"),
        T.memorization_taxonomy(d, m, 10, strict=True).alias("strict_taxonomy"),
        T.threshold_pair(F.col("length"), 1000, d, 7).alias("pair"),
    )


@query(f"WITH {_TAX} SELECT code_type, nl_score > 0.457414 AS is_nl, count(*) AS n FROM t GROUP BY ALL")
def code_type_band(spark, sf):
    return _tax(spark, sf).groupBy("code_type", (F.col("nl_score") > 0.457414).alias("is_nl")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_TAX} SELECT lang, taxonomy, count(*) AS n FROM t GROUP BY ALL")
def category_counts(spark, sf):
    return _tax(spark, sf).groupBy("lang", "taxonomy").agg(F.count(F.lit(1)).alias("n"))


_PIVOT = ", ".join(f"nullif(count(*) FILTER (taxonomy = '{c}'), 0) AS {c}" for c in (T.RECITATION, T.RECONSTRUCTION, T.RECOLLECTION))


@query(f"WITH {_TAX} SELECT source, {_PIVOT} FROM t GROUP BY source")
def category_counts_pivot(spark, sf):
    return _tax(spark, sf).groupBy("source").pivot("taxonomy", [T.RECITATION, T.RECONSTRUCTION, T.RECOLLECTION]).count()


@query(f"WITH {_TAX}, c AS (SELECT lang, taxonomy, count(*) AS n FROM t GROUP BY ALL) SELECT lang, taxonomy, round(n::DOUBLE / sum(n) OVER (PARTITION BY lang), 6) AS share, (n * 100 // sum(n) OVER (PARTITION BY lang))::BIGINT AS percent FROM c")
def category_shares(spark, sf):
    c = _tax(spark, sf).groupBy("lang", "taxonomy").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("lang"))
    return c.select("lang", "taxonomy", r9(F.col("n") / total).alias("share"), F.floor(F.col("n") * 100 / total).alias("percent"))


@query(f"""WITH {_TAX} SELECT lang, coalesce(taxonomy, 'all') AS taxonomy, coalesce(code_type, 'all') AS code_type, count(*) AS n FROM t
GROUP BY GROUPING SETS ((lang, taxonomy, code_type), (lang, taxonomy), (lang))""")
def category_subtotals(spark, sf):
    c = _tax(spark, sf).groupingSets([["lang", "taxonomy", "code_type"], ["lang", "taxonomy"], ["lang"]], "lang", "taxonomy", "code_type").agg(F.count(F.lit(1)).alias("n"))
    return c.select("lang", F.coalesce("taxonomy", F.lit("all")).alias("taxonomy"), F.coalesce("code_type", F.lit("all")).alias("code_type"), "n")


@query(f"""WITH {_TAX}, c AS (SELECT lang, code_type, taxonomy, count(*) AS n FROM t GROUP BY ALL)
SELECT lang, code_type, taxonomy, round(n::DOUBLE / sum(n) OVER (PARTITION BY lang, code_type), 6) AS p FROM c""")
def conditional_proportions(spark, sf):
    c = _tax(spark, sf).groupBy("lang", "code_type", "taxonomy").agg(F.count(F.lit(1)).alias("n"))
    return c.select("lang", "code_type", "taxonomy", r9(F.col("n") / F.sum("n").over(Window.partitionBy("lang", "code_type"))).alias("p"))


@query(f"WITH {FRAME} SELECT count(*) FILTER (label = 0) AS n_0, count(*) FILTER (label = 1) AS n_1, round(avg(CASE WHEN label = 0 THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS share_0 FROM frame")
def class_priors(spark, sf):
    y = F.col("label")
    return frame(spark, sf).agg(F.count_if(y == 0).alias("n_0"), F.count_if(y == 1).alias("n_1"), r9(F.avg((y == 0).cast("double"))).alias("share_0"))


@query(f"WITH {_TAX} SELECT taxonomy, count(*) > 0 AND count(*) FILTER (label = 1) > 0 AND count(*) FILTER (label = 0) > 0 AS eligible FROM t GROUP BY taxonomy")
def taxonomy_eligibility(spark, sf):
    y = F.col("label")
    return _tax(spark, sf).groupBy("taxonomy").agg(((F.count_if(y == 1) > 0) & (F.count_if(y == 0) > 0)).alias("eligible"))


@query("SELECT count(DISTINCT doc_id) AS doc_id, count(DISTINCT lang) AS lang, count(DISTINCT source) AS source, count(DISTINCT n_chars) AS n_chars FROM documents")
def nunique_columns(spark, sf):
    return table(spark, sf, "documents").agg(*(F.count_distinct(c).alias(c) for c in ("doc_id", "lang", "source", "n_chars")))


@query("""SELECT l_returnflag, round(quantile_cont(l_quantity, 0.25), 6) AS q25, round(quantile_cont(l_extendedprice, 0.5), 6) AS q50, round(quantile_cont(l_discount, 0.75), 6) AS q75
FROM lineitem GROUP BY l_returnflag""")
def quantile_thresholds(spark, sf):
    wanted = {"q25": ("l_quantity", 0.25), "q50": ("l_extendedprice", 0.5), "q75": ("l_discount", 0.75)}
    return ordering.quantile_columns(table(spark, sf, "lineitem"), wanted, "l_returnflag").withColumns({c: r9(F.col(c)) for c in wanted})


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars > 10 AND n_chars <= (SELECT quantile_cont(n_chars, 0.99) FROM documents WHERE n_chars > 10)")
def percentile_bound_filter(spark, sf):
    d = table(spark, sf, "documents").where("n_chars > 10").select("doc_id", "n_chars")
    bound = ordering.quantile_columns(d, {"__bound": ("n_chars", 0.99)})  # one row
    return d.crossJoin(F.broadcast(bound)).where("n_chars <= __bound").drop("__bound")


@query("""SELECT o_orderpriority, count(o_totalprice) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd, min(o_totalprice) AS least,
  round(quantile_cont(o_totalprice, 0.25), 4) AS q25, round(quantile_cont(o_totalprice, 0.5), 4) AS q50, round(quantile_cont(o_totalprice, 0.75), 4) AS q75, max(o_totalprice) AS most FROM orders GROUP BY o_orderpriority""")
def grouped_describe(spark, sf):
    x = F.col("o_totalprice")
    o = table(spark, sf, "orders")
    t = o.groupBy("o_orderpriority").agg(F.count(x).alias("n"), F.round(F.avg(x), 4).alias("mean"), F.round(F.stddev_samp(x), 4).alias("sd"), F.min(x).alias("least"), F.max(x).alias("most"))
    q = ordering.quantile_columns(o, {f"q{p}": ("o_totalprice", p / 100) for p in (25, 50, 75)}, "o_orderpriority")
    return t.join(q, "o_orderpriority").withColumns({f"q{p}": F.round(f"q{p}", 4) for p in (25, 50, 75)})


@query("""WITH b AS (SELECT least(floor((l_extendedprice - 900) / 5000), 20)::BIGINT AS bin FROM lineitem)
SELECT bin, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM b), 6) AS percent FROM b GROUP BY bin""")
def histogram_linear(spark, sf):
    b = table(spark, sf, "lineitem").select(F.least(F.floor((F.col("l_extendedprice") - 900) / 5000), F.lit(20)).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    return b.withColumn("percent", r9(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy())))


@query("""WITH b AS (SELECT floor(log10(n_chars) * 4)::BIGINT AS bin FROM documents WHERE n_chars > 0) SELECT bin, count(*) AS n FROM b GROUP BY bin""")
def histogram_log(spark, sf):
    return table(spark, sf, "documents").where("n_chars > 0").groupBy(F.floor(F.log10("n_chars") * 4).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_chars - n_chars % 250 AS bucket, count(*) AS n, round(avg(n_chars), 4) AS mean FROM documents GROUP BY 1")
def floor_buckets(spark, sf):
    b = F.col("n_chars") - F.pmod(F.col("n_chars"), F.lit(250))
    return table(spark, sf, "documents").groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 4).alias("mean"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def top_k_max(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 100")
def top_k_min(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy("o_totalprice", "o_orderkey").limit(100)


@query("SELECT o_orderstatus, max(o_totalprice) AS most, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS best_order FROM orders GROUP BY o_orderstatus")
def best_row(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.max("o_totalprice").alias("most"), F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("best_order"))


def _order_sql(id: str) -> str:
    return f"md5({id}::VARCHAR || '-42'), {id}"


@query(f"""WITH {FRAME} SELECT id, score >= 0.5 AS high FROM (SELECT *, row_number() OVER (PARTITION BY score >= 0.5 ORDER BY {_order_sql('id')}) AS r FROM frame) WHERE r <= 50""")
def balanced_sample(spark, sf):
    f = frame(spark, sf).withColumn("high", F.col("score") >= 0.5)
    return sampling.sample_per_group(f, 50, F.col("high"), "id").select("id", "high")


@query(f"SELECT doc_id FROM documents ORDER BY {_order_sql('doc_id')} LIMIT 200")
def exact_sample(spark, sf):
    return sampling.sample_rows(table(spark, sf, "documents").select("doc_id"), 200, "doc_id")


@query(f"""WITH {_TAX}, s AS (SELECT id, label::VARCHAR || taxonomy AS stratum FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {_order_sql('id')}) AS r, count(*) OVER (PARTITION BY stratum) AS n FROM s)
SELECT id, stratum, CASE WHEN (r - 1)::DOUBLE / n < 0.8 THEN 0 WHEN (r - 1)::DOUBLE / n < 0.9 THEN 1 ELSE 2 END AS split FROM r""")
def stratified_split(spark, sf):
    s = _tax(spark, sf).select("id", T.stratify_key(F.col("label"), F.col("taxonomy")).alias("stratum"))
    return sampling.stratified_split(s, "stratum", "id", [0.8, 0.9])


@query("SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR || '-42'), 1, 8))::BIGINT % 100 AS fold FROM documents")
def kfold_ids(spark, sf):
    return table(spark, sf, "documents").select("doc_id", sampling.fold_of("doc_id", 100).alias("fold"))


@query(f"""WITH {FRAME}, r AS (SELECT id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_order_sql('id')}) AS r FROM frame), m AS (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM frame GROUP BY lang))
SELECT id, lang FROM r, m WHERE r <= m""")
def equal_groups(spark, sf):
    return sampling.balance_groups(frame(spark, sf).select("id", "lang"), "lang", "id")


@query(f"""WITH {FRAME}, p AS (SELECT source, avg(score) AS p, avg(base_score) AS r, stddev_pop(score) AS dp, stddev_pop(base_score) AS dr FROM frame GROUP BY source)
SELECT source, round(2 * p * r / (p + r), 6) AS f1, round(2 / pow(p + r, 2) * sqrt(pow(r, 4) * dp * dp + pow(p, 4) * dr * dr), 6) AS f1_error FROM p""")
def f1_with_error(spark, sf):
    p = frame(spark, sf).groupBy("source").agg(F.avg("score").alias("p"), F.avg("base_score").alias("r"), F.stddev_pop("score").alias("dp"), F.stddev_pop("base_score").alias("dr"))
    c = [F.col(x) for x in ("p", "r", "dp", "dr")]
    return p.select("source", r9(M.f1_score(*c[:2])).alias("f1"), r9(M.f1_error(*c)).alias("f1_error"))


@query("""SELECT source, regexp_extract(source, '([0-9]+)$', 1)::INT AS number, upper(substr(source, 1, 1)) || substr(source, 2) AS title, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source""")
def parsed_names(spark, sf):
    s = F.col("source")
    return table(spark, sf, "documents").where(s.isNotNull()).groupBy("source").agg(F.count(F.lit(1)).alias("n")).select("source", F.regexp_extract(s, r"(\d+)$", 1).try_cast("int").alias("number"), F.initcap(s).alias("title"), "n")


@query("""SELECT source, sum(n_chars)::BIGINT AS chars, count(*) AS n, count(*) FILTER (n_chars > 1000) AS long_texts, round(avg(CASE WHEN n_chars > 1000 THEN 100.0 ELSE 0.0 END)::DOUBLE, 6) AS long_percent FROM documents GROUP BY source""")
def sums_per_source(spark, sf):
    long = F.col("n_chars") > 1000
    return table(spark, sf, "documents").groupBy("source").agg(F.sum("n_chars").alias("chars"), F.count(F.lit(1)).alias("n"), F.count_if(long).alias("long_texts"), r9(F.avg(long.cast("double")) * 100).alias("long_percent"))


@query("""WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) SELECT source, coalesce(max(n) FILTER (lang = 'en'), 0) AS en, coalesce(max(n) FILTER (lang = 'fr'), 0) AS fr,
  round(100.0::DOUBLE * (coalesce(max(n) FILTER (lang = 'fr'), 0) - coalesce(max(n) FILTER (lang = 'en'), 0)) / nullif(max(n) FILTER (lang = 'en'), 0), 6) AS delta_percent FROM c GROUP BY source""")
def count_deltas(spark, sf):
    c = table(spark, sf, "documents").groupBy("source").pivot("lang", ["en", "fr"]).count().na.fill(0)
    return c.withColumn("delta_percent", r9(F.try_divide(100.0 * (F.col("fr") - F.col("en")), F.col("en"))))


@query(f"WITH {FRAME}, c AS (SELECT source, count(*) FILTER (label = 1) AS hit, count(*) AS n FROM frame GROUP BY source) SELECT source, hit::VARCHAR || ' (' || (100 * hit // n)::VARCHAR || '%)' AS cell FROM c")
def formatted_cells(spark, sf):
    c = frame(spark, sf).groupBy("source").agg(F.count_if(F.col("label") == 1).alias("hit"), F.count(F.lit(1)).alias("n"))
    return c.select("source", F.format_string("%d (%d%%)", "hit", F.floor(100 * F.col("hit") / F.col("n"))).alias("cell"))
