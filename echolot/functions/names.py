"""Names of models, splits, checkpoints and metrics as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parameters of each model size, in natural order.
PARAMETERS = {"70m": 70e6, "160m": 160e6, "410m": 410e6, "1b": 1e9, "1.4b": 1.4e9, "2.8b": 2.8e9, "6.9b": 6.9e9, "12b": 12e9}
#: Steps of a whole training run.
TRAINING_STEPS = 143_000
_SIZE = r"(\d+(?:\.\d+)?[mb])"


def model_size(split: Column) -> Column:
    """12b of deduped.12b.23000; null if there is none."""
    found = F.regexp_extract(split, rf"(?:^|\.){_SIZE}(?:\.|$)", 1)
    return F.when(found != "", found)


def checkpoint(split: Column) -> Column:
    """Training progress of the split as a share of all steps; 1 without a step."""
    step = F.regexp_extract(split, rf"{_SIZE}\.(\d+)$", 2).try_cast("double")
    return F.coalesce(step / TRAINING_STEPS, F.lit(1.0))


def parameters(size: Column) -> Column:
    """Number of parameters, which also orders sizes (70m before 1b)."""
    pairs = [x for k, v in PARAMETERS.items() for x in (F.lit(k), F.lit(v))]
    return F.element_at(F.create_map(*pairs), size)


def is_split(name: Column, schemes: tuple[str, ...] = ("deduped", "duped")) -> Column:
    return name.rlike(rf"^({'|'.join(schemes)})\.{_SIZE}(\.\d+)?$")


def display_name(name: Column, known: dict[str, str]) -> Column:
    """A stated name, or the words of the column name in title case."""
    plain = F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))
    if not known:
        return plain
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in known.items() for x in kv)), name), plain)


def metric_key(key: Column) -> Column:
    """model, taxonomy and metric of model_taxonomy_metric (the metric may hold more underscores)."""
    parts = F.split(key, "_", 3)
    return F.struct(*(F.try_element_at(parts, F.lit(i + 1)).alias(n) for i, n in enumerate(("model", "taxonomy", "metric"))))
