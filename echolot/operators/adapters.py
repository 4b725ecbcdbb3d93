"""Where a neural model comes in: a function made once per task scores batches of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Scorer = Callable[[pd.DataFrame], pd.DataFrame]


def score_batches(rows: DataFrame, make_scorer: Callable[[], Scorer], schema: str, columns: list[str] | None = None) -> DataFrame:
    """make_scorer() is called in each task (it loads the model); its function turns a batch into rows of the schema."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for batch in batches:
            if len(batch):
                yield scorer(batch)

    return (rows if columns is None else rows.select(*columns)).mapInPandas(run, schema)


def class_share(scores: Column, threshold: float = 0.457414) -> Column:
    """Percent of rows whose score is above a threshold."""
    return F.avg((scores > threshold).cast("double")) * 100


def mean_dependency_distance(heads: Column) -> Column:
    """Mean distance of each token (by place, from 0) to its head, from a parser's array of heads."""
    far = F.transform(heads, lambda h, i: F.abs(h - i).cast("double"))
    return F.try_divide(F.aggregate(far, F.lit(0.0), lambda a, x: a + x), F.size(heads))
