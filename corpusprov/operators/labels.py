"""Labels of URLs: parsing responses and scoring them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusprov.operators.counts import with_share

# How a response holds its JSON, and the JSON's fields.
FENCED_JSON = r"(?s)```json\n(.*?)\n```"
LABEL_SCHEMA = "url string, is_news boolean, reason string"


def parse_response(text: str | Column) -> Column:
    """Struct of the fenced JSON in a response; NULL fields when it cannot be read."""
    t = F.col(text) if isinstance(text, str) else text
    body = F.regexp_extract(t, FENCED_JSON, 1)
    return F.when(body != "", F.from_json(body, LABEL_SCHEMA))


def label_metrics(df: DataFrame, truth: str, models: dict[str, str]) -> DataFrame:
    """Accuracy, precision, recall and F1 of each model's 0/1 column, in one pass.

    A zero denominator gives 0.
    """
    y = F.col(truth).cast("int")
    sums = []
    for i, column in enumerate(models.values()):
        p = F.col(column).cast("int")
        for name, cond in (("tp", (p == 1) & (y == 1)), ("fp", (p == 1) & (y == 0)),
                           ("fn", (p == 0) & (y == 1)), ("tn", (p == 0) & (y == 0))):
            sums.append(F.count(F.when(cond, 1)).alias(f"{name}{i}"))

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b == 0, 0.0).otherwise(a.cast("double") / b)

    cells = []
    for i, model in enumerate(models):
        tp, fp, fn, tn = (F.col(f"{n}{i}") for n in ("tp", "fp", "fn", "tn"))
        cells.append(F.struct(
            F.lit(model).alias("model"),
            ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
            ratio(tp, tp + fp).alias("precision"),
            ratio(tp, tp + fn).alias("recall"),
            ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ))
    return df.agg(*sums).select(F.inline(F.array(*cells)))


def flag_counts(df: DataFrame, flag: str) -> DataFrame:
    """Rows per value of a flag, with their percentage, ordered by the flag."""
    counted = df.groupBy(flag).agg(F.count(F.lit(1)).alias("n"))
    return with_share(counted, "n", "pct", 100.0).orderBy(flag)
