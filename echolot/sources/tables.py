"""Tables with stated schemas, and the files that reports and logs are kept in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordering import quantile_columns, row_places

#: Schemas of the known tables, as DDL.
SCHEMAS = {
    "sequences": "sequence_id long, tokens array<int>",
    "sequence_frequencies": "sequence_id long, frequency long",
    "token_frequencies": "token_id int, frequency long",
    "code_scores": "sequence_id long, nl_scores double",
    "semantic_matches": "sequence_id long, 0_8_frequencies long, 0_9_frequencies long",
    "gram_hashes": "sequence_id long, offset int, gram_hash long",
    "annotations": "shortened_text string, Category string",
    "labelled_texts": "label int, index long, text string",
}
#: Model sizes of the wide sample, in natural order.
MODELS = ("70m", "160m", "410m", "1b", "1.4b", "2.8b", "6.9b", "12b")


def read_table(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A Parquet table, checked against its schema (extra columns are dropped, types are cast, a missing column is an error)."""
    schema = T.StructType.fromDDL(_quoted(SCHEMAS[kind]))
    rows = spark.read.parquet(path)
    if missing := [f.name for f in schema if f.name not in rows.columns]:
        raise ValueError(f"{path} lacks {missing}, which {kind} tables have")
    return rows.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema))


def _quoted(ddl: str) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in (x.split(" ", 1) for x in ddl.split(", ")))


def wide_sample(spark: SparkSession, path: str, last_tokens: int | None = None) -> DataFrame:
    """The wide sample: sequence_id, tokens and a score for each of MODELS."""
    from ..functions.sequences import last_tokens as tail

    rows = spark.read.parquet(path).withColumnsRenamed({"Index": "sequence_id", "Tokens": "tokens"})
    tokens = F.col("tokens") if last_tokens is None else tail(F.col("tokens"), last_tokens)
    return rows.select("sequence_id", tokens.alias("tokens"), *(F.col(f"`{m}`").cast("double").alias(m) for m in MODELS if m in rows.columns))


def feature_table(spark: SparkSession, path: str, kind: str, test_rows: int | None = None) -> DataFrame:
    """A feature table; test_rows takes the first rows in order of the key, for small trial runs."""
    rows = read_table(spark, path, kind)
    return rows if test_rows is None else rows.orderBy(rows.columns[0]).limit(test_rows)


def split_name(split: str) -> str:
    """deduped.1.4b to deduped_1.4b: only the first point changes."""
    return split.replace(".", "_", 1)


def write_table(rows: DataFrame, path: str, partition_by: list[str] | None = None, files: int | None = None, mode: str = "errorifexists") -> None:
    """Parquet.  files=1 uses repartition, so the work before it keeps its parallelism."""
    out = rows if files is None else rows.repartition(files)
    w = out.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def read_hashes_csv(spark: SparkSession, path: str) -> DataFrame:
    """Headerless CSV of n-gram hashes."""
    return spark.read.schema(SCHEMAS["gram_hashes"]).option("header", False).csv(path)


def write_hashes_csv(hashes: DataFrame, path: str) -> None:
    """The same: sequence, offset and hash of each window, without a header; a file for each partition."""
    hashes.select("sequence_id", "offset", "gram_hash").write.option("header", False).csv(path)


def write_report_csv(rows: DataFrame, path: str) -> None:
    rows.repartition(1).write.mode("overwrite").option("header", True).csv(path)


def read_labelled_tsv(spark: SparkSession, *paths: str) -> DataFrame:
    """Tab-separated label, index, text; lines without a numeric index (two title lines each) go."""
    rows = spark.read.option("sep", "\t").option("mode", "PERMISSIVE").schema("label string, index string, text string").csv(list(paths))
    rows = rows.select(F.col("label").try_cast("double").cast("int").alias("label"), F.col("index").try_cast("long").alias("index"), "text")
    return rows.where("index is not null")


def read_appended_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV to which every append added its header again: lines that repeat the header go."""
    names = [f.name for f in T.StructType.fromDDL(schema)]
    rows = spark.read.schema(", ".join(f"`{n}` string" for n in names)).csv(path).where(F.col(f"`{names[0]}`") != names[0])
    return rows.select(*(F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(schema)))


def token_frequencies_json(spark: SparkSession, path: str) -> DataFrame:
    """{"memorized": [...], "non_memorized": [...]} to token_id, memorized, non_memorized."""
    rows = spark.read.schema("memorized array<long>, non_memorized array<long>").option("multiLine", True).json(path)
    both = rows.select(F.posexplode(F.arrays_zip("memorized", "non_memorized")).alias("token_id", "x"))
    return both.select("token_id", "x.memorized", "x.non_memorized")


def write_token_frequencies_json(counts: DataFrame, path: str, slots: int = 60_000) -> None:
    """The same document: one bounded row, with a slot for every token id."""
    spark = counts.sparkSession
    every = spark.range(slots).withColumnRenamed("id", "token_id").join(counts, "token_id", "left")
    ordered = every.agg(F.sort_array(F.collect_list(F.struct("token_id", F.coalesce("memorized", F.lit(0)).alias("m"), F.coalesce("non_memorized", F.lit(0)).alias("n")))).alias("x"))
    ordered.select(F.transform("x", lambda x: x["m"]).alias("memorized"), F.transform("x", lambda x: x["n"]).alias("non_memorized")).write.mode("overwrite").json(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One id in a line."""
    return spark.read.text(path).select(F.trim("value").try_cast("long").alias("sequence_id")).where("sequence_id is not null")


def positions_text(positions: DataFrame, path: str, most: int = 100_000) -> None:
    """Lines of a hash and its positions in order; a hash of more than ``most`` positions has a line for each ``most`` of them."""
    placed = row_places(positions.select("gram_hash", "sequence_id", "offset"), ["gram_hash"], {"__s": F.col("sequence_id"), "__o": F.col("offset")})
    lines = placed.groupBy("gram_hash", F.floor(F.col("__place") / most).alias("part")).agg(F.sort_array(F.collect_list(F.struct("sequence_id", "offset"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: F.concat_ws(":", x["sequence_id"].cast("string"), x["offset"].cast("string"))), " ")
    lines.select(F.concat_ws(" ", F.col("gram_hash").cast("string"), text).alias("value")).write.mode("overwrite").text(path)


def experiment_metrics(spark: SparkSession, pattern: str) -> DataFrame:
    """JSON metric files of experiment folders: feature and quantile of both thresholds from the path, one row for each metric."""
    rows = spark.read.option("multiLine", True).option("wholetext", True).text(pattern).select(F.input_file_name().alias("path"), F.from_json("value", "map<string,double>").alias("m"))
    part = lambda i: F.regexp_extract("path", r"([^/]+)-([0-9.]+)/([^/]+)-([0-9.]+)/[^/]*$", i)
    return rows.select(part(1).alias("feature_1"), part(2).try_cast("double").alias("quantile_1"), part(3).alias("feature_2"), part(4).try_cast("double").alias("quantile_2"), F.explode("m").alias("metric", "value"))


def slice_by_percent(rows: DataFrame, key: str, first: int, last: int) -> DataFrame:
    """Rows whose key is in the given percent band of the key's range order (first to last)."""
    bounds = quantile_columns(rows, {"__lo": (key, first / 100), "__hi": (key, last / 100)})
    out = rows.crossJoin(F.broadcast(bounds))  # one row
    top = F.col(key) <= F.col("__hi") if last == 100 else F.col(key) < F.col("__hi")
    return out.where((F.col(key) >= F.col("__lo")) & top).drop("__lo", "__hi")


def write_metrics_json(spark: SparkSession, metrics: dict[str, float], path: str) -> None:
    """One JSON document of name and value."""
    spark.createDataFrame([(k, float(v)) for k, v in metrics.items()], "metric string, value double").repartition(1).write.mode("overwrite").json(path)
