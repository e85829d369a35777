"""Names of datasets, pairs and crawl snapshots."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the spelling of a crawl snapshot id, either separator, any case.
SNAPSHOT = r"(?i)CC[_-]MAIN[_-](\d{4})[_-](\d{2})"
SNAPSHOT_YEAR = r"(?i)CC[_-]MAIN[_-](\d{4})[_-]"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_name(name: str | Column) -> Column:
    """Slash, dash and dot become underscores."""
    return F.translate(_col(name), "/-.", "___")


def last_part(name: str | Column) -> Column:
    return F.element_at(F.split(_col(name), "/"), -1)


def basename(path: str | Column) -> Column:
    return last_part(F.trim(_col(path)))


def output_name(dataset: str | Column, variant: str | Column) -> Column:
    """``<last part>_urls``, plus ``_<variant>`` unless it is ``default``."""
    v = _col(variant)
    return F.concat(
        last_part(dataset),
        F.lit("_urls"),
        F.when(v == "default", "").otherwise(F.concat(F.lit("_"), v)),
    )


def _side_name(names: Column, word: str) -> Column:
    first = last_part(F.get(names, F.lit(0)))
    short = F.substring_index(first, "_", 1)
    return F.when(F.size(names) == 1, first).otherwise(
        F.concat(F.size(names).cast("string"), F.lit(f"_{word}_"), short)
    )


def pair_key(sources: str | Column, targets: str | Column) -> Column:
    """Readable key of a (sources, targets) pair of name arrays."""
    return F.concat(
        _side_name(_col(sources), "sources"), F.lit("_to_"), _side_name(_col(targets), "targets")
    )


def is_crawl(name: str | Column) -> Column:
    c = _col(name)
    return c.contains("CC-MAIN") | c.contains("CC_MAIN")


def fold_crawl_parent(name: str | Column) -> Column:
    """Every crawl snapshot counts as one parent; other names lose their owner."""
    c = _col(name)
    return F.when(c.contains("/CC"), "Common Crawl").otherwise(last_part(c))


def snapshot_part(name: str | Column, part: str) -> Column:
    """Year or week number of a crawl snapshot id; NULL when the id has none."""
    c = _col(name)
    text = {
        "year": F.regexp_extract(c, SNAPSHOT_YEAR, 1),
        "week": F.regexp_extract(c, SNAPSHOT, 2),
    }[part]
    return text.try_cast("int")


def snapshot_monday(year: str | Column, week: str | Column) -> Column:
    """Monday of a week, where week 1 starts on the first Monday of the year."""
    y, w = _col(year), _col(week)
    first = F.next_day(F.date_sub(F.make_date(y, F.lit(1), F.lit(1)), 1), "MON")
    return F.date_add(first, (w - 1) * 7)


def year_month_date(year: str | Column, month: str | Column) -> Column:
    return F.make_date(_col(year), _col(month), F.lit(1))
