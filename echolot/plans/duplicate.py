"""Duplicates by n-grams, similarity, joins of features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequences as S
from ..operators import duplicates as D
from ..operators import similarity
from .base import MEM, SEQ, memorized, query, sequences, table

GRAMS = SEQ + """, grams AS (SELECT sequence_id, i AS "offset", array_to_string(tokens[i + 1:i + 32], '_') AS gram FROM (SELECT sequence_id, tokens, unnest(range(0, len(tokens) - 31)) AS i FROM seq))"""


@query(f"WITH {GRAMS} SELECT sequence_id, count(*) AS n, count(DISTINCT gram) AS n_distinct FROM grams GROUP BY sequence_id")
def ngram_enumerate_count(spark, sf):
    return D.gram_totals(sequences(spark, sf), 32)


@query(f"""WITH {GRAMS}, c AS (SELECT gram, count(*) AS n FROM grams GROUP BY gram)
SELECT sequence_id, coalesce(n, 1) AS sequence_duplicates FROM seq LEFT JOIN (SELECT sequence_id, n FROM grams JOIN c USING (gram) WHERE "offset" = 32) USING (sequence_id)""")
def continuation_duplicate_count(spark, sf):
    return D.continuation_duplicates(sequences(spark, sf))


_POWERS = ", ".join(str(pow(S.HASH_BASE, i, S.HASH_MODULUS)) for i in range(8))
_HASHES = SEQ + f""", h AS (SELECT sequence_id, i AS "offset", (list_sum([(tokens[i + k]::HUGEINT * ([{_POWERS}]::HUGEINT[])[k]) % {S.HASH_MODULUS} FOR k IN range(1, 9)])::HUGEINT % {S.HASH_MODULUS})::BIGINT AS gram_hash
FROM (SELECT sequence_id, tokens, unnest(range(0, len(tokens) - 7)) AS i FROM seq))"""


@query(f"""WITH {_HASHES} SELECT sequence_id, "offset", gram_hash FROM h""")
def polynomial_ngram_hash(spark, sf):
    return D.gram_hashes(sequences(spark, sf), 8).select("sequence_id", F.col("offset").cast("long").alias("offset"), "gram_hash")


@query(f"""WITH {_HASHES}, c AS (SELECT gram_hash, count(*) AS n FROM h GROUP BY gram_hash HAVING count(*) >= 2)
SELECT gram_hash, n, sequence_id, "offset" FROM h JOIN c USING (gram_hash)""")
def approx_duplicate_positions(spark, sf):
    return D.approximate_duplicates(sequences(spark, sf), 8).withColumn("offset", F.col("offset").cast("long"))


@query(f"""WITH {_HASHES} SELECT DISTINCT gram_hash FROM h WHERE "offset" = 32""")
def distinct_continuation_grams(spark, sf):
    return D.grams_at(D.gram_hashes(sequences(spark, sf), 8), 32)


@query(f"""WITH {_HASHES} SELECT sequence_id, count(*) AS n FROM h WHERE gram_hash IN (SELECT gram_hash FROM h WHERE "offset" = 32) GROUP BY sequence_id""")
def windows_of_continuation_grams(spark, sf):
    s = sequences(spark, sf)
    return D.windows_of(s, D.grams_at(D.gram_hashes(s, 8), 32), 8).groupBy("sequence_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SEQ} SELECT min(sequence_id) AS sequence_id FROM seq GROUP BY tokens")
def unique_prefix_sequences(spark, sf):
    return D.unique_prefixes(sequences(spark, sf))


@query("SELECT md5(text) AS content, count(DISTINCT doc_id) AS n_ids, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(DISTINCT doc_id) > 1")
def duplicate_text_groups(spark, sf):
    out = D.duplicate_groups(table(spark, sf, "documents").where("text is not null"), "text", "doc_id")
    return out.select(F.md5("text").alias("content"), "n_ids", "first_id")


@query("SELECT d.doc_id AS sequence_id, coalesce(l.n, 1) AS count FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM labels WHERE quality = 1 GROUP BY doc_id) l USING (doc_id)")
def fill_default_counts(spark, sf):
    ids = table(spark, sf, "documents").select(F.col("doc_id").alias("sequence_id"))
    counts = table(spark, sf, "labels").where("quality = 1").groupBy(F.col("doc_id").alias("sequence_id")).count()
    return D.fill_counts(ids, counts)


@query("""WITH c AS (SELECT text, count(*) AS frequency FROM documents WHERE text IS NOT NULL GROUP BY text), f AS (SELECT doc_id, frequency FROM documents JOIN c USING (text))
SELECT d.doc_id AS sequence_id, f.frequency AS sequence_duplicates, CAST(l.quality AS DOUBLE) / 2 AS nl_scores, l.toxic AS snowclones
FROM documents d LEFT JOIN f USING (doc_id) LEFT JOIN labels l USING (doc_id)""")
def feature_joins(spark, sf):
    from .filters import FeatureSet, code_vs_natural_language, run, semantic_matches, sequence_duplicates

    d, l = table(spark, sf, "documents"), table(spark, sf, "labels")
    copies = d.where("text is not null").groupBy("text").agg(F.count(F.lit(1)).alias("frequency"))
    features = FeatureSet(
        sequence_frequencies=d.join(copies, "text").select(F.col("doc_id").alias("sequence_id"), "frequency"),
        code_scores=l.select(F.col("doc_id").alias("sequence_id"), (F.col("quality") / 2).alias("nl_scores")),
        snowclones=l.select(F.col("doc_id").alias("sequence_id"), F.col("toxic").alias("0_8_frequencies"), F.col("toxic").alias("0_9_frequencies")),
    )
    out = run(d.select(F.col("doc_id").alias("sequence_id")), features, (sequence_duplicates, code_vs_natural_language, semantic_matches))
    return out.select("sequence_id", "sequence_duplicates", "nl_scores", F.col("0_8_snowclones").alias("snowclones"))


@query("SELECT doc_id AS sequence_id, model, CAST(score AS DOUBLE) AS memorization_score FROM (SELECT d.doc_id, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)) UNPIVOT (score FOR model IN (quality, toxic))")
def memorization_score_by_model(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id")
    scores = rows.select(F.col("doc_id").alias("sequence_id"), F.col("quality").cast("double").alias("quality"), F.col("toxic").cast("double").alias("toxic"))
    return scores.unpivot("sequence_id", ["quality", "toxic"], "model", "memorization_score").where("memorization_score is not null")


@query("""WITH e AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings WHERE embedding IS NOT NULL),
p AS (SELECT a.vec_id AS query_id, list_cosine_similarity(a.v, b.v) AS c FROM e a, e b)
SELECT query_id, count(*) FILTER (c >= 0.8) AS n_0, count(*) FILTER (c >= 0.9) AS n_1, count(*) FILTER (c >= 0.4) AS n_2 FROM p GROUP BY query_id""")
def snowclone_counts(spark, sf):
    e = table(spark, sf, "embeddings")
    return similarity.match_counts(e, e, [0.8, 0.9, 0.4])


_PROMPTS = r"""p AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS v, array_to_string((string_split_regex(trim(text), '\s+'))[1:32], ' ') AS t FROM embeddings JOIN documents ON vec_id = doc_id)"""


@query(f"""WITH {_PROMPTS}, m AS (SELECT a.vec_id AS query_id, count(*) AS n FROM p a, p b WHERE NOT regexp_matches(a.t, '[^\\x00-\\x7F]') AND list_cosine_similarity(a.v, b.v) >= 0.0
  AND abs(length(a.t) - length(b.t)) < 20 AND levenshtein(a.t, b.t) BETWEEN 1 AND 19 GROUP BY a.vec_id)
SELECT p.vec_id AS query_id, coalesce(n, 0) AS n FROM p LEFT JOIN m ON p.vec_id = m.query_id""")
def template_counts(spark, sf):
    prompts = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), F.array_join(S.first_tokens(S.words(F.col("text")), 32), " ").alias("text"))
    rows = table(spark, sf, "embeddings").join(prompts, "vec_id")
    return similarity.template_counts(rows, rows, 0.0)


@query(f"WITH {MEM} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM mem)")
def id_difference(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(memorized(spark, sf), "doc_id", "left_anti")


@query("SELECT DISTINCT lang, source FROM documents")
def distinct_rows(spark, sf):
    return table(spark, sf, "documents").select("lang", "source").distinct()


@query("SELECT doc_id AS id, 'document' AS kind, lang, NULL::INT AS quality FROM documents UNION ALL SELECT doc_id, 'label', NULL, quality FROM labels")
def union_frames(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit("document").alias("kind"), "lang")
    l = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.lit("label").alias("kind"), "quality")
    return d.unionByName(l, allowMissingColumns=True)


@query("""WITH u AS (SELECT doc_id, 0 AS priority, n_chars FROM documents WHERE n_chars % 2 = 0 UNION ALL SELECT doc_id, 1, n_chars + 1 FROM documents)
SELECT doc_id, priority, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY priority, n_chars) AS r FROM u) WHERE r = 1""")
def dedup_keep_first(spark, sf):
    d = table(spark, sf, "documents")
    u = d.where("n_chars % 2 = 0").select("doc_id", F.lit(0).alias("priority"), "n_chars").unionByName(d.select("doc_id", F.lit(1).alias("priority"), (F.col("n_chars") + 1).alias("n_chars")))
    return D.keep_first(u, "doc_id", "priority", "n_chars")


@query("""WITH a AS (SELECT doc_id, n_chars AS value FROM documents), b AS (SELECT doc_id, quality AS value FROM labels)
SELECT a.doc_id, a.value AS value_x, b.value AS value_y FROM a JOIN b USING (doc_id)""")
def merge_with_suffixes(spark, sf):
    a = table(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("value_x"))
    return a.join(table(spark, sf, "labels").select("doc_id", F.col("quality").alias("value_y")), "doc_id")


@query("""WITH c AS (SELECT text, source, count(DISTINCT doc_id) AS n FROM documents WHERE text IS NOT NULL GROUP BY ALL)
SELECT md5(text) AS content, count(DISTINCT source) AS n_sources, sum(n)::BIGINT AS n_ids FROM c GROUP BY text HAVING count(DISTINCT source) > 1""")
def contents_across_sources(spark, sf):
    c = table(spark, sf, "documents").where("text is not null").groupBy("text", "source").agg(F.count_distinct("doc_id").alias("n"))
    return c.groupBy("text").agg(F.count_distinct("source").alias("n_sources"), F.sum("n").alias("n_ids")).where("n_sources > 1").select(F.md5("text").alias("content"), "n_sources", "n_ids")


@query(f"""WITH {SEQ} SELECT sequence_id, (length(array_to_string(tokens, '')) - length(replace(array_to_string(tokens, ''), array_to_string(tokens[1:1], ''), ''))) // length(array_to_string(tokens[1:1], '')) AS n FROM seq""")
def sublist_occurrences(spark, sf):
    return sequences(spark, sf).select("sequence_id", S.count_sublist(F.col("tokens"), F.slice("tokens", 1, 1)).cast("long").alias("n"))


