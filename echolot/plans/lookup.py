"""Look-ups, alignments, subsets and proportions of categories over checkpoints."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import measures as M
from ..operators import stats
from .base import FRAME, SEQ, frame, query, r9, sequences, table

#: Fixed value: the category of a sequence that a checkpoint has not memorized.
DEFAULT = "Not Memorized"
CHECKPOINTS = ("quality", "toxic")

# The two label columns stand for checkpoints; a document's source is its category where the label is 1.
_LOOKUP = """l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT d.doc_id AS sequence_id, d.lang, CASE WHEN quality = 1 THEN source ELSE 'Not Memorized' END AS quality, CASE WHEN toxic = 1 THEN source ELSE 'Not Memorized' END AS toxic FROM documents d LEFT JOIN l USING (doc_id))"""


def categories(spark, sf):
    """sequence_id, lang and the category at each checkpoint."""
    marks = table(spark, sf, "labels").groupBy("doc_id").agg(*(F.max(c).alias(f"__{c}") for c in CHECKPOINTS))
    rows = table(spark, sf, "documents").select("doc_id", "lang", "source").join(marks, "doc_id", "left")
    return rows.select(F.col("doc_id").alias("sequence_id"), "lang", *(F.coalesce(F.when(F.col(f"__{c}") == 1, F.col("source")), F.lit(DEFAULT)).alias(c) for c in CHECKPOINTS))


@query(f"WITH {_LOOKUP} SELECT sequence_id, quality, toxic FROM c")
def category_by_checkpoint(spark, sf):
    return categories(spark, sf).select("sequence_id", *CHECKPOINTS)


@query(f"""WITH {_LOOKUP}, u AS (SELECT lang, checkpoint, category FROM c UNPIVOT (category FOR checkpoint IN (quality, toxic))),
n AS (SELECT checkpoint, category, lang, count(*) AS n FROM u GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY checkpoint) AS total, sum(n) OVER (PARTITION BY checkpoint, category) AS every FROM n)
SELECT checkpoint, category, lang, round(n / total, 6) AS share, round(every / total, 6) AS all_memories FROM t""")
def category_proportions(spark, sf):
    rows = categories(spark, sf).unpivot(["sequence_id", "lang"], list(CHECKPOINTS), "checkpoint", "category")
    n = rows.groupBy("checkpoint", "category", "lang").agg(F.count(F.lit(1)).alias("n"))
    whole = n.groupBy("checkpoint").agg(F.sum("n").alias("total"))
    each = n.groupBy("checkpoint", "category").agg(F.sum("n").alias("all"))
    out = n.join(whole, "checkpoint").join(each, ["checkpoint", "category"])
    return out.select("checkpoint", "category", "lang", r9(F.col("n") / F.col("total")).alias("share"), r9(F.col("all") / F.col("total")).alias("all_memories"))


@query("WITH u AS (SELECT min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY text) SELECT doc_id, quality, toxic FROM labels WHERE doc_id IN (SELECT doc_id FROM u)")
def rows_of_unique_index(spark, sf):
    unique = table(spark, sf, "documents").where("text is not null").groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    return table(spark, sf, "labels").select("doc_id", "quality", "toxic").join(unique, "doc_id", "left_semi")


@query("""WITH e AS (SELECT vec_id AS id, round(list_sum([x::DOUBLE FOR x IN embedding]), 6) AS score FROM embeddings WHERE embedding IS NOT NULL)
SELECT d.doc_id AS id, n_chars, score FROM documents d LEFT JOIN e ON d.doc_id = e.id""")
def scores_aligned_by_key(spark, sf):
    e = table(spark, sf, "embeddings").where("embedding is not null")
    scores = e.select(F.col("vec_id").alias("id"), r9(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)).alias("score"))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "n_chars").join(scores, "id", "left")


_SUBSETS = {"recited": "duplicates >= 6 AND duplicates < 10", "rare": "duplicates <= 2", "between": "length BETWEEN 100 AND 600", "templated": "templating = 1", "long_natural": "length > 600 AND nl_score >= 0.5"}


@query(f"WITH {FRAME} " + " UNION ALL ".join(f"SELECT '{k}' AS subset, id FROM frame WHERE {v}" for k, v in _SUBSETS.items()))
def subset_filters(spark, sf):
    names = F.array_compact(F.array(*(F.when(F.expr(v), F.lit(k)) for k, v in _SUBSETS.items())))
    return frame(spark, sf).select(F.explode(names).alias("subset"), "id")


@query(f"WITH {FRAME} SELECT id, CASE WHEN label = 1 THEN 'false negative' ELSE 'false positive' END AS error, score FROM frame WHERE (score >= 0.5) <> (label = 1)")
def prediction_errors(spark, sf):
    said, true = F.col("score") >= 0.5, F.col("label") == 1
    return frame(spark, sf).where(said != true).select("id", F.when(true, "false negative").otherwise("false positive").alias("error"), "score")


@query(f"WITH {FRAME} SELECT source, max(length) AS most, min(length) AS least, round(avg(nl_score), 6) AS mean FROM frame GROUP BY source")
def grouped_extremes(spark, sf):
    return frame(spark, sf).groupBy("source").agg(F.max("length").alias("most"), F.min("length").alias("least"), r9(F.avg("nl_score")).alias("mean"))


@query(f"WITH {SEQ} SELECT DISTINCT md5(g) AS gram FROM (SELECT array_to_string(tokens[1:8], '_') AS g FROM seq WHERE len(tokens) >= 8 UNION ALL SELECT array_to_string(tokens[33:40], '_') FROM seq WHERE len(tokens) >= 40)")
def union_of_grams(spark, sf):
    t = F.col("tokens")
    grams = F.array_compact(F.array(*(F.when(F.size(t) >= at + 7, F.slice(t, at, 8)) for at in (1, 33))))
    return sequences(spark, sf).select(F.explode(grams).alias("g")).select(F.md5(F.array_join(F.col("g").cast("array<string>"), "_")).alias("gram")).distinct()


@query(f"""WITH {FRAME}, g AS (SELECT lang, CASE WHEN nl_score >= 0.5 THEN 'nl' ELSE 'code' END AS subset, length AS x, label AS y FROM frame),
a AS (SELECT unnest(['all', lang]) AS lang, subset, x, y FROM g), b AS (SELECT lang, unnest(['all', subset]) AS subset, x, y FROM a),
r AS (SELECT lang, subset, rank() OVER (PARTITION BY lang, subset ORDER BY x) + (count(*) OVER (PARTITION BY lang, subset, x) - 1) / 2 AS x, rank() OVER (PARTITION BY lang, subset ORDER BY y) + (count(*) OVER (PARTITION BY lang, subset, y) - 1) / 2 AS y FROM b)
SELECT lang, subset, round(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 6) AS statistic, count(*) AS n FROM r GROUP BY ALL""")
def rank_correlation_grid(spark, sf):
    f = frame(spark, sf).select("lang", F.when(F.col("nl_score") >= 0.5, "nl").otherwise("code").alias("subset"), "length", "label")
    return stats.spearman(stats.in_groups(f, "lang", "subset"), "length", "label", "lang", "subset").withColumn("statistic", r9(F.col("statistic")))


# An embedding's four quarters stand for attention heads, and whether its id is odd for the layer.
@query("""WITH v AS (SELECT vec_id, vec_id % 2 AS layer, [x::DOUBLE FOR x IN embedding] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) >= 4),
h AS (SELECT vec_id, layer, k AS head, e[(len(e) // 4) * k + 1:(len(e) // 4) * (k + 1)] AS e FROM (SELECT *, unnest(range(0, 4)) AS k FROM v)),
x AS (SELECT vec_id, layer, head, [exp(y - list_max(e)) FOR y IN e] AS x FROM h), w AS (SELECT layer, head, [y / list_sum(x) FOR y IN x] AS w FROM x), s AS (SELECT layer, head, -list_sum([y * ln(y + 1e-8) FOR y IN w]) AS s FROM w)
SELECT layer, head, round(avg(s), 6) AS entropy FROM s GROUP BY GROUPING SETS ((layer, head), (layer), ())""")
def attention_entropy_means(spark, sf):
    part = F.floor(F.size("e") / 4).cast("int")
    v = table(spark, sf, "embeddings").where("embedding is not null and size(embedding) >= 4").select(F.pmod("vec_id", F.lit(2)).alias("layer"), F.col("embedding").cast("array<double>").alias("e"))
    heads = v.select("layer", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.slice("e", part * k + 1, part))).alias("head", "e"))
    entropies = heads.withColumn("w", M.softmax(F.col("e"))).select("layer", F.col("head").cast("long").alias("head"), M.attention_entropy(F.col("w")).alias("s"))
    return entropies.groupingSets([["layer", "head"], ["layer"], []], "layer", "head").agg(r9(F.avg("s")).alias("entropy")).select("layer", "head", "entropy")


@query(f"""WITH {SEQ}, h AS (SELECT sequence_id, array_to_string(tokens[1:8], '_') AS g FROM seq WHERE len(tokens) >= 8)
SELECT sequence_id, count(*) OVER (PARTITION BY g) AS n FROM h""")
def opening_gram_counts(spark, sf):
    grams = sequences(spark, sf).where(F.size("tokens") >= 8).select("sequence_id", F.slice("tokens", 1, 8).alias("text"))
    counts = grams.groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    return grams.join(counts, "text").select("sequence_id", "n")
