"""Tables kept by what they were made from.

``cached`` gives the table that a function makes from some DataFrames and parameters.  Its key is a digest of the name, the parameters,
and of each input its schema, its plan's constants and its files with length and time, so a changed parameter or file is another key and
old tables are never read for new inputs.  A table is written to a folder of its own; then a manifest, written under another name and
renamed, makes it valid.  A run that ends before that leaves no manifest, and its folder is never read.  Two runs that make the
same table at once each write their own folder, and the manifest that is renamed first counts.

Works on any file system that Spark can write; renaming has to be atomic for one file, which holds for HDFS and local folders.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

from ..scratch import file_system


@dataclass(frozen=True)
class Manifest:
    """What a valid table says of itself."""

    name: str
    key: str
    folder: str
    rows: int
    schema: str
    parameters: dict


def fingerprint(rows: DataFrame) -> list:
    """Schema, and path, length and time of each file that the rows are read from; for rows without files (made in Spark) a hash of their plan."""
    context = rows.sparkSession.sparkContext
    files = []
    for path in sorted(rows.inputFiles()):
        fs, at = file_system(context, path)
        status = fs.getFileStatus(at)
        files.append([path, status.getLen(), status.getModificationTime()])
    # What happens between files and rows is in the plan; expression ids (#12) differ between runs of one program.
    plan = re.sub(r"#\d+L?|\[plan_id.*?\]", "", rows._jdf.queryExecution().optimizedPlan().toString())
    return [rows.schema.json(), files, plan]


def cache_key(name: str, parameters: Mapping, inputs: Mapping[str, DataFrame]) -> str:
    """The digest that names a table; parameters have to be plain values (JSON)."""
    what = [name, dict(parameters), {k: fingerprint(v) for k, v in sorted(inputs.items())}]
    return hashlib.sha256(json.dumps(what, sort_keys=True).encode()).hexdigest()[:32]


def _read_text(spark: SparkSession, path: str) -> str:
    return "".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect())


def _write_once(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file beside its place and renames it; False if the place was taken meanwhile."""
    fs, at = file_system(spark.sparkContext, path)
    _, draft = file_system(spark.sparkContext, f"{path}.{uuid.uuid4().hex[:8]}")
    out = fs.create(draft)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.exists(at) and fs.rename(draft, at):
        return True
    fs.delete(draft, False)
    return False


def find(spark: SparkSession, base: str, name: str, key: str) -> Manifest | None:
    """The manifest of a valid table, if there is one."""
    path = f"{base}/{name}/{key}.json"
    fs, at = file_system(spark.sparkContext, path)
    return Manifest(**json.loads(_read_text(spark, path))) if fs.exists(at) else None


def cached(spark: SparkSession, base: str, name: str, inputs: Mapping[str, DataFrame], parameters: Mapping, make: Callable[..., DataFrame]) -> DataFrame:
    """The table that ``make(**inputs, **parameters)`` gives, from the cache if it is there, else made and kept."""
    key = cache_key(name, parameters, inputs)
    found = find(spark, base, name, key)
    if found is None:
        folder = f"{base}/{name}/{key}-{uuid.uuid4().hex[:8]}"
        made = make(**inputs, **parameters)
        made.write.parquet(folder)
        manifest = Manifest(name, key, folder, spark.read.parquet(folder).count(), made.schema.json(), dict(parameters))
        if _write_once(spark, f"{base}/{name}/{key}.json", json.dumps(asdict(manifest))):
            found = manifest
        else:
            fs, at = file_system(spark.sparkContext, folder)
            fs.delete(at, True)
            found = find(spark, base, name, key)
    return spark.read.parquet(found.folder)


def manifests(spark: SparkSession, base: str, name: str) -> list[Manifest]:
    """All valid tables of a name."""
    fs, at = file_system(spark.sparkContext, f"{base}/{name}")
    if not fs.exists(at):
        return []
    return [Manifest(**json.loads(_read_text(spark, f.getPath().toString()))) for f in fs.listStatus(at) if f.getPath().getName().endswith(".json")]


def forget(spark: SparkSession, base: str, name: str, key: str | None = None) -> int:
    """Deletes the tables of a name (or the one of a key), manifests first, and folders that no manifest names; returns how many tables were valid.

    Not to be called while another run makes a table of that name.
    """
    gone = [m for m in manifests(spark, base, name) if key in (None, m.key)]
    for m in gone:
        for path in (f"{base}/{name}/{m.key}.json", m.folder):
            fs, at = file_system(spark.sparkContext, path)
            fs.delete(at, True)
    kept = {m.folder.rsplit("/", 1)[-1] for m in manifests(spark, base, name)}
    fs, at = file_system(spark.sparkContext, f"{base}/{name}")
    for f in fs.listStatus(at) if fs.exists(at) else []:
        own = f.getPath().getName()
        if f.isDirectory() and own not in kept and (key is None or own.startswith(f"{key}-")):
            fs.delete(f.getPath(), True)
    return len(gone)
