"""Token frequencies, code length, array measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import measures as M
from ..functions import patterns
from ..functions import sequences as S
from ..operators import frequencies as Q
from ..scratch import written
from .base import COUNTS, MEM, SEQ, TOK, memorized, query, r9, sequences, spread, table, tokenised


@query(f"WITH {SEQ}, {MEM}, {COUNTS} SELECT token_id, memorized, non_memorized FROM counts")
def token_frequency_split(spark, sf):
    return Q.token_counts(sequences(spark, sf), memorized(spark, sf), "doc_id")


@query(f"""WITH {SEQ}, {MEM}, {COUNTS}, t AS (SELECT sum(memorized + non_memorized) AS total FROM counts)
SELECT token_id, memorized + non_memorized AS occurrences, round(memorized::DOUBLE / (memorized + non_memorized), 6) AS memorized_probability,
  round(total::DOUBLE / (memorized + non_memorized), 6) AS unigram_perplexity FROM counts, t""")
def token_probability_perplexity(spark, sf):
    return Q.token_probabilities(Q.token_counts(sequences(spark, sf), memorized(spark, sf), "doc_id")).withColumns({c: r9(F.col(c)) for c in ("memorized_probability", "unigram_perplexity")})


def _feature_tables(spark, sequences, sf):
    """Memorized and non-memorized frequencies of the sequences; a token that occurs on one side only is missing on the other.  Counted once and written."""
    counts = written(Q.token_counts(sequences, memorized(spark, sf), "doc_id"), "counts")
    return tuple(counts.where(F.col(c) > 0).select("token_id", F.col(c).alias("frequency")) for c in ("memorized", "non_memorized"))


_STATS = f"""WITH {SEQ}, {MEM}, {COUNTS}, ex AS (SELECT sequence_id, unnest(tokens) AS token_id, generate_subscripts(tokens, 1) AS i FROM seq),
f AS (SELECT sequence_id, i, CASE WHEN memorized > 0 AND non_memorized > 0 THEN memorized + non_memorized END AS f FROM ex LEFT JOIN counts USING (token_id))
"""


@query(_STATS + """SELECT sequence_id, max(f) AS max_frequency, round(avg(f), 6) AS avg_frequency, min(f) AS min_frequency, round(median(f), 6) AS median_frequency,
  quantile_disc(f, 0.25) AS p25_frequency, quantile_disc(f, 0.75) AS p75_frequency FROM f GROUP BY sequence_id""")
def token_frequency_statistics(spark, sf):
    s = sequences(spark, sf)
    out = Q.frequency_statistics(s, *_feature_tables(spark, s, sf))
    return out.select("sequence_id", "max_frequency", r9(F.col("avg_frequency")).alias("avg_frequency"), "min_frequency", r9(F.col("median_frequency")).alias("median_frequency"), "p25_frequency", "p75_frequency")


@query(_STATS + """SELECT sequence_id, array_to_string(list(coalesce(f::VARCHAR, 'null') ORDER BY i), ' ') AS frequencies FROM f GROUP BY sequence_id""")
def token_frequency_list(spark, sf):
    s = sequences(spark, sf)
    out = Q.frequency_statistics(s, *_feature_tables(spark, s, sf))
    return out.select("sequence_id", F.array_join(F.col("frequencies").cast("array<string>"), " ", "null").alias("frequencies"))


@query(f"""WITH {SEQ}, {MEM}, {COUNTS}, ex AS (SELECT sequence_id, unnest(tokens) AS token_id, generate_subscripts(tokens, 1) AS i FROM seq)
SELECT sequence_id, array_to_string(list(token_id ORDER BY i), ' ') AS tokens, array_to_string(list(memorized ORDER BY i), ' ') AS memorized,
  array_to_string(list(non_memorized ORDER BY i), ' ') AS non_memorized FROM ex JOIN counts USING (token_id) GROUP BY sequence_id""")
def token_frequency_lists_by_kind(spark, sf):
    s = sequences(spark, sf)
    counts = written(Q.token_counts(s, memorized(spark, sf), "doc_id"), "counts")
    lists = Q.token_lists(s, counts, {"memorized": "long", "non_memorized": "long"})
    return lists.select("sequence_id", *(F.array_join(F.col(c).cast("array<string>"), " ").alias(c) for c in ("tokens", "memorized", "non_memorized")))


@query(f"""WITH {SEQ}, {MEM}, {COUNTS}, t AS (SELECT sum(memorized + non_memorized) AS total FROM counts), ex AS (SELECT sequence_id, unnest(tokens) AS token_id FROM seq)
SELECT sequence_id, max(memorized + non_memorized) AS max_occurrences, min(memorized + non_memorized) AS min_occurrences,
  round(max(total::DOUBLE / (memorized + non_memorized)), 6) AS max_perplexity, round(min(total::DOUBLE / (memorized + non_memorized)), 6) AS min_perplexity
FROM ex JOIN counts USING (token_id), t GROUP BY sequence_id""")
def sequence_frequency_extremes(spark, sf):
    s = sequences(spark, sf)
    counts = written(Q.token_counts(s, memorized(spark, sf), "doc_id"), "counts")
    out = Q.sequence_extremes(s, Q.token_probabilities(counts))
    return out.withColumns({c: r9(F.col(c)) for c in ("max_perplexity", "min_perplexity")})


@query("""WITH c AS (SELECT doc_id AS sequence_id, unnest(string_split(text, '')) AS x FROM documents), n AS (SELECT sequence_id, x, count(*) AS k FROM c WHERE x <> '' GROUP BY ALL),
p AS (SELECT sequence_id, k::DOUBLE / sum(k) OVER (PARTITION BY sequence_id) AS p FROM n), s AS (SELECT sequence_id, sum(ceil(-log2(p)) * p) AS v FROM p GROUP BY sequence_id)
SELECT doc_id AS sequence_id, round(CASE WHEN text = '' THEN 0 ELSE v END, 6) AS code_length FROM documents LEFT JOIN s ON doc_id = sequence_id""")
def code_length_chars(spark, sf):
    texts = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return texts.select(F.col("doc_id").alias("sequence_id"), r9(patterns.text_code_length("text")).alias("code_length"))


@query(f"""WITH {SEQ}, c AS (SELECT sequence_id, unnest(tokens) AS x FROM seq), n AS (SELECT sequence_id, x, count(*) AS k FROM c GROUP BY ALL),
p AS (SELECT sequence_id, k::DOUBLE / sum(k) OVER (PARTITION BY sequence_id) AS p FROM n)
SELECT sequence_id, round(sum(ceil(-log2(p)) * p), 6) AS code_length FROM p GROUP BY sequence_id""")
def code_length_tokens(spark, sf):
    return sequences(spark, sf).select("sequence_id", r9(M.code_length(F.col("tokens").cast("array<string>"))).alias("code_length"))


@query(f"""WITH {SEQ} SELECT sequence_id, array_to_string(tokens[greatest(len(tokens) - 31, 1):], '_') AS last_key, array_to_string(tokens[1:32], '_') AS prompt_key, array_to_string(tokens, '') AS digits FROM seq""")
def sequence_keys(spark, sf):
    t = F.col("tokens")
    return sequences(spark, sf).select("sequence_id", S.sequence_key(S.last_tokens(t, 32)).alias("last_key"), S.sequence_key(S.first_tokens(t, 32)).alias("prompt_key"), S.sequence_key(t, "").alias("digits"))


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\n\t]', ' ', 'g'), ' +', ' ', 'g')) AS normalised, regexp_matches(text, '[^\x00-\x7F]') AS non_ascii FROM documents""")
def normalised_texts(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", S.normalise_text(t).alias("normalised"), S.has_non_ascii(t).alias("non_ascii"))


def _run_sql(good: str) -> str:
    return f"""WITH {TOK}, ex AS (SELECT sequence_id, unnest(tokens)::VARCHAR AS x, generate_subscripts(tokens, 1) AS i FROM tok),
s AS (SELECT sequence_id, i, coalesce(x {good} lag(x) OVER w, false) AS g FROM ex WINDOW w AS (PARTITION BY sequence_id ORDER BY i)),
b AS (SELECT sequence_id, g AND NOT coalesce(lag(g) OVER w, false) AS b FROM s WINDOW w AS (PARTITION BY sequence_id ORDER BY i))
SELECT sequence_id, count(*) FILTER (b) AS runs FROM b GROUP BY sequence_id"""


@query(_run_sql(">"))
def increasing_run_count(spark, sf):
    return tokenised(spark, sf).select("sequence_id", M.increasing_runs(F.col("tokens")).cast("long").alias("runs"))


@query(_run_sql("<="))
def non_increasing_run_count(spark, sf):
    return tokenised(spark, sf).select("sequence_id", M.non_increasing_runs(F.col("tokens")).cast("long").alias("runs"))


# Embedding components stand in for log probabilities (negative) and attention weights (positive).
_VEC = "v AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS e FROM embeddings WHERE embedding IS NOT NULL)"


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").where("embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))


@query(f"""WITH {_VEC}, p AS (SELECT vec_id, [-abs(x) - 0.1 FOR x IN e] AS p FROM v)
SELECT vec_id, round(exp(-list_sum(p[1:len(p) // 2]) / len(p)), 6) AS prompt_perplexity, round(exp(-list_sum(p[len(p) // 2 + 1:]) / len(p)), 6) AS generation_perplexity,
  round(exp(-list_sum(p) / len(p)), 6) AS sequence_perplexity FROM p""")
def perplexity_triple(spark, sf):
    p = M.perplexities(F.transform("e", lambda x: -F.abs(x) - 0.1))
    return _vectors(spark, sf).select("vec_id", *(r9(p[k]).alias(f"{k}_perplexity") for k in ("prompt", "generation", "sequence")))


@query(f"""WITH {_VEC}, s AS (SELECT vec_id, list_sort([x - least(list_min(e), 0) FOR x IN e]) AS s FROM v)
SELECT vec_id, round(list_sum([(2 * i - len(s) - 1) * s[i] FOR i IN range(1, len(s) + 1)]) / (len(s) * list_sum(s)), 6) AS gini FROM s""")
def gini(spark, sf):
    return _vectors(spark, sf).select("vec_id", r9(M.gini(F.col("e"))).alias("gini"))


@query(f"""WITH {_VEC}, x AS (SELECT vec_id, [exp(y - list_max(e)) FOR y IN e] AS x FROM v), w AS (SELECT vec_id, [y / list_sum(x) FOR y IN x] AS w FROM x)
SELECT vec_id, round(-list_sum([y * ln(y + 1e-8) FOR y IN w]), 6) AS entropy FROM w""")
def attention_entropy(spark, sf):
    return _vectors(spark, sf).withColumn("w", M.softmax(F.col("e"))).select("vec_id", r9(M.attention_entropy(F.col("w"))).alias("entropy"))


@query(f"""WITH {_VEC}, t AS (SELECT vec_id, [floor(x * 1000) FOR x IN e] AS a FROM v)
SELECT vec_id, len(a)::BIGINT AS n, round(list_sum(a), 6) AS total FROM t""")
def stringified_array_parse(spark, sf):
    text = F.concat(F.lit("["), F.array_join(F.transform("e", lambda x: F.floor(x * 1000).cast("string")), "  "), F.lit("]"))
    a = M.parse_array(F.col("t"))
    return _vectors(spark, sf).withColumn("t", text).select("vec_id", F.size(a).cast("long").alias("n"), r9(F.aggregate(a, F.lit(0.0), lambda x, y: x + y)).alias("total"))
