"""Metrics, statistics and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns, repeats
from ..functions.sequences import count_sublist
from ..operators import metrics, modeling, stats
from ..scratch import written
from .base import FRAME, LENGTH, PIECES, frame, query, r9, sequences, spread, table


@query(f"""WITH {FRAME}, s AS (SELECT avg(length) AS m, stddev_pop(length) AS d, avg(duplicates) AS m2, stddev_pop(duplicates) AS d2 FROM frame)
SELECT id, round((length - m) / d, 6) AS length, round((duplicates - m2) / d2, 6) AS duplicates FROM frame, s""")
def standardise_features(spark, sf):
    f = frame(spark, sf).withColumn("duplicates", F.col("duplicates").cast("double"))
    return modeling.fit_scaling(f, ["length", "duplicates"]).apply(f).select("id", r9(F.col("length")).alias("length"), r9(F.col("duplicates")).alias("duplicates"))


@query(f"""WITH {FRAME}, c AS (SELECT lang, greatest(score, 1 - score) AS c, CASE WHEN (score > 1 - score)::INT = label THEN 1.0 ELSE 0.0 END AS r FROM frame),
b AS (SELECT lang, ceil(c * 5) AS bin, avg(c) AS c, avg(r) AS r, count(*) AS n FROM c GROUP BY ALL) SELECT lang, round(sum(abs(c - r) * n) / sum(n), 6) AS ece FROM b GROUP BY lang""")
def ece_bins(spark, sf):
    return metrics.calibration_error(frame(spark, sf), "label", "score", 5, "lang").select("lang", r9(F.col("ece")).alias("ece"))


@query(f"""WITH {FRAME}, r AS (SELECT lang, label, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0 AS r FROM frame),
s AS (SELECT lang, sum(r) FILTER (label = 1) AS s, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM r GROUP BY lang)
SELECT lang, round((s - p * (p + 1) / 2.0)::DOUBLE / (p * n), 6) AS roc_auc FROM s""")
def roc_auc(spark, sf):
    return metrics.roc_auc(frame(spark, sf), "label", "score", "lang").select("lang", r9(F.col("roc_auc")).alias("roc_auc"))


_CURVE = FRAME + """, g AS (SELECT lang, score, sum(label)::BIGINT AS pos, sum(1 - label)::BIGINT AS neg FROM frame GROUP BY ALL),
c AS (SELECT lang, score, (sum(pos) OVER w)::BIGINT AS tp, (sum(neg) OVER w)::BIGINT AS fp, (sum(pos) OVER (PARTITION BY lang))::BIGINT AS p, (sum(neg) OVER (PARTITION BY lang))::BIGINT AS n FROM g WINDOW w AS (PARTITION BY lang ORDER BY score DESC))"""


@query(f"WITH {_CURVE} SELECT lang, score, tp, fp, round(tp::DOUBLE / (tp + fp), 6) AS precision, round(tp::DOUBLE / p, 6) AS recall, round(fp::DOUBLE / n, 6) AS fpr, round(2.0::DOUBLE * tp / (tp + fp + p), 6) AS f1 FROM c")
def pr_curve(spark, sf):
    return metrics.curve(frame(spark, sf), "label", "score", "lang").withColumns({c: r9(F.col(c)) for c in ("precision", "recall", "fpr", "f1")})


@query(f"""WITH {_CURVE}, s AS (SELECT lang, (tp::DOUBLE / p - coalesce(lag(tp::DOUBLE / p) OVER (PARTITION BY lang ORDER BY score DESC), 0)) * tp / (tp + fp) AS x FROM c)
SELECT lang, round(sum(x), 6) AS average_precision FROM s GROUP BY lang""")
def average_precision(spark, sf):
    return metrics.average_precision(frame(spark, sf), "label", "score", "lang").select("lang", r9(F.col("average_precision")).alias("average_precision"))


@query(f"""WITH {FRAME}, f AS (SELECT ('0x' || substr(md5(id::VARCHAR || '-42'), 1, 8))::BIGINT % 10 AS fold, label, score > 0.5 AS p FROM frame),
c AS (SELECT fold, count(*) FILTER (label = 1 AND p) AS tp, count(*) FILTER (label = 0 AND p) AS fp, count(*) FILTER (label = 1 AND NOT p) AS fn, count(*) FILTER (label = 0 AND NOT p) AS tn FROM f GROUP BY fold)
SELECT fold, tp, fp, fn, tn, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""")
def confusion_metrics(spark, sf):
    from ..operators.sampling import fold_of

    f = frame(spark, sf).withColumns({"fold": fold_of("id", 10), "predicted": F.col("score") > 0.5})
    return metrics.confusion(f, "label", "predicted", "fold").withColumns({c: r9(F.col(c)) for c in ("precision", "recall", "f1")})


@query(f"""WITH {FRAME}, r AS (SELECT lang AS label, CASE WHEN score > 0.4 THEN lang WHEN score > 0.2 THEN 'en' ELSE 'xx' END AS predicted FROM frame), t AS (SELECT label, count(*) AS support, count(*) FILTER (label = predicted) AS hit FROM r GROUP BY label),
s AS (SELECT predicted AS label, count(*) AS said FROM r GROUP BY predicted), j AS (SELECT label, coalesce(support, 0) AS support, coalesce(hit, 0) AS hit, coalesce(said, 0) AS said FROM t FULL JOIN s USING (label)),
m AS (SELECT label, support, coalesce(hit::DOUBLE / nullif(said, 0), 0) AS p, coalesce(hit::DOUBLE / nullif(support, 0), 0) AS r FROM j)
SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1, support FROM m""")
def annotation_report(spark, sf):
    guess = F.when(F.col("score") > 0.4, F.col("lang")).when(F.col("score") > 0.2, "en").otherwise("xx")
    out = metrics.class_report(frame(spark, sf).select("lang", guess.alias("predicted")), "lang", "predicted")
    return out.withColumns({c: r9(F.col(c)) for c in ("precision", "recall", "f1")})


@query(f"WITH {FRAME} SELECT lang, round(covar_pop(length, label) / nullif(stddev_pop(length) * stddev_pop(label), 0), 6) AS statistic, count(*) AS n FROM frame GROUP BY lang")
def correlations_pearson(spark, sf):
    return stats.pearson(frame(spark, sf), "length", "label", "lang").withColumn("statistic", r9(F.col("statistic")))


@query(f"""WITH {FRAME}, r AS (SELECT lang, rank() OVER (PARTITION BY lang ORDER BY duplicates) + (count(*) OVER (PARTITION BY lang, duplicates) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY lang ORDER BY label) + (count(*) OVER (PARTITION BY lang, label) - 1) / 2.0 AS b FROM frame)
SELECT lang, round(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0), 6) AS statistic, count(*) AS n FROM r GROUP BY lang""")
def correlations_spearman(spark, sf):
    return stats.spearman(frame(spark, sf), "duplicates", "label", "lang").withColumn("statistic", r9(F.col("statistic")))


@query(f"""WITH {FRAME}, r AS (SELECT lang, duplicates AS x, id, count(*) OVER (PARTITION BY lang ORDER BY score) AS r, count(*) OVER (PARTITION BY lang ORDER BY score DESC) AS l, count(*) OVER (PARTITION BY lang) AS n FROM frame),
d AS (SELECT lang, l, n, abs(lead(r) OVER (PARTITION BY lang ORDER BY x, id) - r) AS d FROM r)
SELECT lang, round(1 - max(n) * sum(d)::DOUBLE / (2 * sum(l * (n - l))::DOUBLE), 6) AS statistic, max(n) AS n FROM d GROUP BY lang""")
def correlation_xi(spark, sf):
    return stats.xi(frame(spark, sf), "duplicates", "score", "id", "lang").withColumn("statistic", r9(F.col("statistic")))


_LOSS = lambda s: f"-CASE WHEN label = 1 THEN ln(least(greatest({s}, 1e-15), 1 - 1e-15)) ELSE ln(1 - least(greatest({s}, 1e-15), 1 - 1e-15)) END"


@query(f"WITH {FRAME} SELECT round(sum({_LOSS('score')}), 4) AS loss, round(sum({_LOSS('base_score')}), 4) AS base_loss, round(2 * (sum({_LOSS('base_score')}) - sum({_LOSS('score')})), 4) AS statistic FROM frame")
def label_log_loss_lrt(spark, sf):
    a, b = (F.sum(metrics.log_loss(F.col("label"), F.col(c))) for c in ("score", "base_score"))
    return frame(spark, sf).agg(F.round(a, 4).alias("loss"), F.round(b, 4).alias("base_loss"), F.round(2 * (b - a), 4).alias("statistic"))


@query(f"""WITH {FRAME}, s AS (SELECT source, avg(score) AS a, avg(base_score) AS b FROM frame GROUP BY source)
SELECT count(*) AS n, round(avg(a - b), 6) AS mean, round(stddev_samp(a - b), 6) AS sd, round(avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))), 6) AS t FROM s""")
def paired_ttest_sums(spark, sf):
    s = frame(spark, sf).groupBy("source").agg(F.avg("score").alias("a"), F.avg("base_score").alias("b"))
    return stats.paired_sums(s, "a", "b").withColumns({c: r9(F.col(c)) for c in ("mean", "sd", "t")})


@query(f"""WITH {FRAME}, d AS (SELECT duplicates - 11 AS d FROM frame WHERE duplicates <> 11), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r FROM d)
SELECT count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0)::DOUBLE AS w_plus, coalesce(sum(r) FILTER (d < 0), 0)::DOUBLE AS w_minus FROM r""")
def wilcoxon_sums(spark, sf):
    return stats.signed_rank(frame(spark, sf).select("duplicates", F.lit(11).alias("middle")), "duplicates", "middle")


@query(f"""WITH {FRAME}, s AS (SELECT duplicates, (score + 0.001) / sum(score + 0.001) OVER w AS p, (base_score + 0.001) / sum(base_score + 0.001) OVER w AS q FROM frame WINDOW w AS (PARTITION BY duplicates))
SELECT duplicates, round(sum(p * ln(p / q)), 6) AS kl, round(sum(q * ln(q / p)), 6) AS kl_reverse, round((sum(p * ln(p / q)) + sum(q * ln(q / p))) / 2, 6) AS symmetric FROM s GROUP BY duplicates""")
def kl_divergence(spark, sf):
    f = frame(spark, sf).select("duplicates", (F.col("score") + 0.001).alias("p"), (F.col("base_score") + 0.001).alias("q"))
    return stats.kl_divergence(f, "p", "q", "duplicates").withColumns({c: r9(F.col(c)) for c in ("kl", "kl_reverse", "symmetric")})


@query(f"WITH {FRAME} SELECT round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS sd FROM (SELECT source, avg(score) AS x FROM frame GROUP BY source)")
def fold_metric_spread(spark, sf):
    f = frame(spark, sf).groupBy("source").agg(F.avg("score").alias("x"))
    return f.agg(r9(F.avg("x")).alias("mean"), r9(F.stddev_pop("x")).alias("sd"))


# What follows has no SQL: fixed Python rules and fitted models, held by golden values and invariants in the tests.


@query()
def pattern_detection(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", patterns.pattern("text").alias("p"))
    return d.select("doc_id", "p.is_incrementing", "p.is_repeating")


@query()
def chunk_repetition(spark, sf):
    s = sequences(spark, sf).withColumn("c", repeats.chunk("tokens"))
    return s.select("sequence_id", F.array_join(F.col("c.chunk").cast("array<string>"), "_").alias("chunk"), "c.k")


@query()
def repeated_sublists(spark, sf):
    s = sequences(spark, sf).withColumn("sub", repeats.repeated_sublist("tokens"))
    return s.select("sequence_id", F.array_join(F.col("sub").cast("array<string>"), "_").alias("sublist"), F.size("sub").alias("n"))


@query()
def repeated_sublist_ratios(spark, sf):
    """Length of the longest repeated sublist times its occurrences (of its digits in those of the tokens), over the number of tokens."""
    s = sequences(spark, sf).withColumn("sub", repeats.repeated_sublist("tokens"))
    s = s.select("sequence_id", F.size("sub").alias("n"), count_sublist(F.col("tokens"), F.col("sub")).cast("long").alias("occurrences"), F.size("tokens").alias("of"))
    return s.select("sequence_id", "n", "occurrences", r9(F.col("n") * F.col("occurrences") / F.col("of")).alias("ratio"))


@query()
def frequent_substrings(spark, sf):
    s = sequences(spark, sf).select("sequence_id", F.array_join(F.col("tokens").cast("array<string>"), "").alias("digits"))
    return s.select("sequence_id", repeats.frequent_substring("digits").alias("substring"))


@query()
def increasing_runs(spark, sf):
    s = sequences(spark, sf).withColumn("r", patterns.increasing_run(F.col("tokens").cast("array<string>")))
    return s.select("sequence_id", F.size("r").alias("n"), F.array_join("r", "_").alias("items"))


@query()
def metric_pipeline(spark, sf):
    from ..functions.sequences import words
    from .filters import FeatureSet, run
    from .frequency import _feature_tables

    s = sequences(spark, sf)
    m, n = _feature_tables(spark, s, sf)
    copies = s.groupBy("tokens").agg(F.count(F.lit(1)).alias("frequency"))
    features = FeatureSet(sequence_frequencies=s.join(copies, "tokens").select("sequence_id", "frequency"), memorized_token_frequencies=m, non_memorized_token_frequencies=n)
    texts = table(spark, sf, "documents").where("text is not null").select("doc_id", words(F.col("text")).alias("words"))
    part = F.slice("words", (F.col("sequence_id") % PIECES * LENGTH + 1).cast("int"), LENGTH)
    return run(s.join(texts, "doc_id").select("sequence_id", "tokens", F.array_join(part, " ").alias("text")), features)


_FEATURES = ["length", "duplicates", "nl_score", "base_score"]


def _matrix(spark, sf):
    f = frame(spark, sf).withColumn("duplicates", F.col("duplicates").cast("double"))
    return modeling.fit_scaling(f, _FEATURES).apply(f)


@query()
def logistic_predictions(spark, sf):
    f = _matrix(spark, sf)
    out = modeling.predict(modeling.train(f, _FEATURES), f, _FEATURES)
    return out.select("id", "label", F.round(F.col("prediction_probs")[1], 4).alias("score"), "predictions")


@query()
def routed_taxonomy_predictions(spark, sf):
    from ..operators.taxonomy import memorization_taxonomy

    raw = frame(spark, sf).select("id", memorization_taxonomy(F.col("duplicates"), F.col("templating")).alias("taxonomy"))
    f = _matrix(spark, sf).join(raw, "id")
    models = {t: modeling.train(f.where(F.col("taxonomy") == t), _FEATURES) for t in ("recitation", "reconstruction", "recollection")}
    return modeling.routed_predictions(f, "taxonomy", models, _FEATURES).select("id", "label", "taxonomy", F.round("model_score", 4).alias("model_score"), "model_predictions")


@query(f"""WITH {FRAME}, f AS (SELECT *, ('0x' || substr(md5(id::VARCHAR || '-42'), 1, 8))::BIGINT % 10 AS fold FROM frame),
c AS (SELECT fold, greatest(score, 1 - score) AS c, CASE WHEN (score > 1 - score)::INT = label THEN 1.0 ELSE 0.0 END AS r FROM f), b AS (SELECT fold, ceil(c * 10) AS bin, avg(c) AS c, avg(r) AS r, count(*) AS n FROM c GROUP BY ALL),
e AS (SELECT fold, sum(abs(c - r) * n) / sum(n) AS ece FROM b GROUP BY fold), m AS (SELECT fold, count(*) FILTER (label = 1 AND score > 0.5) AS tp, count(*) FILTER (score > 0.5) AS said, count(*) FILTER (label = 1) AS pos FROM f GROUP BY fold)
SELECT fold, round(ece, 6) AS ece, round(coalesce(tp::DOUBLE / nullif(said, 0), 0), 6) AS precision, round(coalesce(tp::DOUBLE / nullif(pos, 0), 0), 6) AS recall FROM e JOIN m USING (fold)""")
def fold_metrics(spark, sf):
    from ..operators.sampling import fold_of

    f = frame(spark, sf).withColumns({"fold": fold_of("id", 10), "predicted": F.col("score") > 0.5})
    c = metrics.confusion(f, "label", "predicted", "fold").select("fold", "precision", "recall")
    out = metrics.calibration_error(f, "label", "score", 10, "fold").join(c, "fold")
    return out.select("fold", *(r9(F.col(x)).alias(x) for x in ("ece", "precision", "recall")))


@query(f"""WITH {FRAME}, g AS (SELECT lang, CASE WHEN nl_score >= 0.5 THEN 'nl' ELSE 'code' END AS subset, length AS x, label AS y FROM frame),
a AS (SELECT unnest(['all', lang]) AS lang, subset, x, y FROM g), b AS (SELECT lang, unnest(['all', subset]) AS subset, x, y FROM a)
SELECT lang, subset, round(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 6) AS statistic, count(*) AS n FROM b GROUP BY ALL""")
def correlation_grid(spark, sf):
    f = frame(spark, sf).select("lang", F.when(F.col("nl_score") >= 0.5, "nl").otherwise("code").alias("subset"), "length", "label")
    return stats.pearson(stats.in_groups(f, "lang", "subset"), "length", "label", "lang", "subset").withColumn("statistic", r9(F.col("statistic")))


_SOURCES = [f"src{k}" for k in range(20)]


@query(f"""WITH {FRAME}, w AS (SELECT lang AS model, source AS feature, avg(score) AS weight FROM frame GROUP BY ALL),
s AS (SELECT model, feature, (weight - avg(weight) OVER p) / CASE WHEN stddev_pop(weight) OVER p = 0 THEN 1 ELSE stddev_pop(weight) OVER p END AS s FROM w WINDOW p AS (PARTITION BY feature))
SELECT model, {", ".join(f"round(max(s) FILTER (feature = '{c}'), 6) AS {c}" for c in _SOURCES)} FROM s GROUP BY model""")
def scaled_weight_matrix(spark, sf):
    w = frame(spark, sf).groupBy(F.col("lang").alias("model"), F.col("source").alias("feature")).agg(F.avg("score").alias("weight"))
    m = stats.scaled_weights(w)
    return m.select("model", *(r9(F.col(c) if c in m.columns else F.lit(None)).alias(c) for c in _SOURCES))


@query()
def chunk_repetition_ratios(spark, sf):
    k = chunk_repetition(spark, sf).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    return k.crossJoin(F.broadcast(k.agg(F.sum("n").alias("total")))).select("k", "n", r9(F.col("n") / F.col("total")).alias("ratio"))  # one row of totals


@query()
def bootstrapped_kl(spark, sf):
    from ..operators.sampling import bootstrap_sums

    f = frame(spark, sf).select("id", (F.col("duplicates") % 4).alias("bucket"), (F.col("score") + 0.001).alias("p"), (F.col("base_score") + 0.001).alias("q"))
    out = stats.kl_of_sums(bootstrap_sums(f, stats.kl_sums("p", "q"), REPLICATES, "id", "bucket"))
    return out.groupBy("bucket").agg(r9(F.avg("symmetric")).alias("mean"), r9(F.stddev_pop("symmetric")).alias("sd"))


#: Replicates of a bootstrap; rows aren't copied for them.
REPLICATES = 1000


def _area_sql(score: str) -> str:
    return f"""SELECT fold, sum(x) AS area FROM (SELECT fold, (r - coalesce(lag(r) OVER w, 0)) * (p + coalesce(lag(p) OVER w, 1)) / 2 AS x FROM (SELECT fold, s, (sum(pos) OVER w)::DOUBLE / (sum(pos) OVER (PARTITION BY fold)) AS r, (sum(pos) OVER w)::DOUBLE / (sum(pos + neg) OVER w) AS p
  FROM (SELECT fold, {score} AS s, sum(label) AS pos, sum(1 - label) AS neg FROM f GROUP BY ALL) WINDOW w AS (PARTITION BY fold ORDER BY s DESC)) WINDOW w AS (PARTITION BY fold ORDER BY s DESC)) GROUP BY fold"""


@query(f"""WITH {FRAME}, f AS (SELECT ('0x' || substr(md5(id::VARCHAR || '-42'), 1, 8))::BIGINT % 10 AS fold, label, score, base_score FROM frame), a AS ({_area_sql('score')}), b AS ({_area_sql('base_score')})
SELECT fold, round(a.area, 6) AS pr_auc, round(b.area, 6) AS base_pr_auc FROM a JOIN b USING (fold)""")
def fold_precision_recall_areas(spark, sf):
    from ..operators.sampling import fold_of

    f = frame(spark, sf).withColumn("fold", fold_of("id", 10))
    a, b = (metrics.area_under_precision_recall(f, "label", s, "fold").select("fold", r9(F.col("pr_auc")).alias(name)) for s, name in (("score", "pr_auc"), ("base_score", "base_pr_auc")))
    return a.join(b, "fold")


@query(f"""WITH {FRAME}, g AS (SELECT unnest(['all', lang]) AS lang, CASE WHEN nl_score >= 0.5 THEN 'nl' ELSE 'code' END AS subset, duplicates AS x, score AS y, id FROM frame),
h AS (SELECT lang, unnest(['all', subset]) AS subset, x, y, id FROM g),
r AS (SELECT lang, subset, x, id, count(*) OVER (PARTITION BY lang, subset ORDER BY y) AS r, count(*) OVER (PARTITION BY lang, subset ORDER BY y DESC) AS l, count(*) OVER (PARTITION BY lang, subset) AS n FROM h),
d AS (SELECT lang, subset, l, n, abs(lead(r) OVER (PARTITION BY lang, subset ORDER BY x, id) - r) AS d FROM r)
SELECT lang, subset, round(1 - max(n) * sum(d)::DOUBLE / nullif(2 * sum(l * (n - l))::DOUBLE, 0), 6) AS statistic, max(n) AS n FROM d GROUP BY ALL""")
def xi_grid(spark, sf):
    f = frame(spark, sf).select("lang", F.when(F.col("nl_score") >= 0.5, "nl").otherwise("code").alias("subset"), "duplicates", "score", "id")
    return stats.xi(stats.in_groups(f, "lang", "subset"), "duplicates", "score", "id", "lang", "subset").withColumn("statistic", r9(F.col("statistic")))


_SHARES = (0.25, 0.5, 0.75)


@query(f"""WITH {FRAME} {" UNION ALL ".join(f"SELECT '{c}' AS feature, {q} AS quantile, round(quantile_cont({c}::DOUBLE, {q}), 6) AS value FROM frame" for c in ("length", "duplicates", "nl_score", "base_score") for q in _SHARES)}""")
def feature_thresholds(spark, sf):
    from ..operators.ordering import quantiles

    q = quantiles(frame(spark, sf), _FEATURES, list(_SHARES))
    return q.select(F.col("column").alias("feature"), F.col("share").alias("quantile"), r9(F.col("value")).alias("value"))


@query(f"""WITH {FRAME}, t AS (SELECT id, CASE WHEN duplicates >= 6 THEN 'recitation' WHEN templating <> 0 THEN 'reconstruction' ELSE 'recollection' END AS taxonomy FROM frame)
SELECT id, (taxonomy = 'recitation')::INT AS is_recitation, (taxonomy = 'reconstruction')::INT AS is_reconstruction, (taxonomy = 'recollection')::INT AS is_recollection FROM t""")
def taxonomy_indicators(spark, sf):
    from ..operators import taxonomy as T

    t = frame(spark, sf).select("id", T.memorization_taxonomy(F.col("duplicates"), F.col("templating")).alias("taxonomy"))
    return modeling.with_indicator(t, "taxonomy", [T.RECITATION, T.RECONSTRUCTION, T.RECOLLECTION]).drop("taxonomy")


def searched(spark, sf):
    """Models of all taxonomies by pairs of quantiles, fitted on nine tenths of the labelled documents, and all rows with their fold."""
    from ..operators import search
    from ..operators.sampling import fold_of

    f = written(_matrix(spark, sf).withColumn("fold", fold_of("id", 10)).select("id", "fold", "label", *_FEATURES), "matrix")
    found = search.candidates(modeling.quantile_thresholds(f, _FEATURES, _SHARES))
    return search.fit_all(f.where("fold > 0"), _FEATURES, found), f


@query()
def taxonomy_search(spark, sf):
    from ..operators import search

    fits, f = searched(spark, sf)
    return search.as_table(spark, [(name, round(x, 4)) for name, x in search.score_all(fits, f.where("fold = 0"))], "candidate string, log_loss double")


@query()
def taxonomy_weights(spark, sf):
    from ..operators import search

    return search.as_table(spark, [(*k, round(w, 4)) for *k, w in searched(spark, sf)[0].rows()], "candidate string, category int, feature string, weight double")


@query()
def taxonomy_wald(spark, sf):
    from ..operators import search

    fits, f = searched(spark, sf)
    return search.as_table(spark, [(*k, round(w, 3)) for *k, w in search.wald_all(fits, f.where("fold > 0"))], "candidate string, category int, feature string, wald double")
