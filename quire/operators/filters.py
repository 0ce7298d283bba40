"""Corpus filters (F1-F12) over a papers DataFrame.

A papers frame has ``base_id``, ``created`` (DATE), ``categories`` (space-
separated string), ``authors``, ``title``; other names can be passed in.
Every filter is one ``where`` conjunction of built-in predicates, so Catalyst
orders them, prunes the scan to the columns they touch and pushes range and
``contains`` predicates into the Parquet reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.categories import category_tokens
from ..functions.dates import date_in_range
from ..functions.ids import regex_match, regex_search, split_versioned_pattern, with_version
from ..session import materialize
from .dedup import dedup_by_key


def _as_list(v):
    if v is None:
        return None
    if isinstance(v, str):
        return [v]
    return list(v)


def category_any_of(categories_col, wanted) -> Column:
    """true when any wanted category is one of the row's tokens."""
    wanted = _as_list(wanted)
    if not wanted:
        return F.lit(True)
    toks = category_tokens(categories_col)
    if len(wanted) == 1:
        return F.array_contains(toks, wanted[0])
    return F.arrays_overlap(toks, F.array(*[F.lit(w) for w in wanted]))


def text_contains(col, needle: str | None, case_sensitive: bool = True) -> Column:
    """Substring test; case-sensitive by default (as the local path)."""
    if not needle:
        return F.lit(True)
    c = F.col(col) if isinstance(col, str) else col
    if case_sensitive:
        return c.contains(needle)
    return F.lower(c).contains(needle.lower())


def paper_predicate(regex_id=None, start_date=None, end_date=None, categories=None,
                    author=None, title=None, *, id_col="base_id", created_col="created",
                    categories_col="categories", authors_col="authors", title_col="title",
                    anchored: bool = False, case_sensitive: bool = True) -> Column:
    """F8 predicate: AND of id pattern (F1 search, or F2 with ``anchored``),
    category any-of (F4), author / title substring (F5, F6), date range (F7)."""
    cond = F.lit(True)
    if regex_id:
        base, _ver, named = split_versioned_pattern(regex_id)
        pat = base if named else regex_id
        if pat:
            cond = cond & (regex_match(id_col, pat) if anchored else regex_search(id_col, pat))
    if categories:
        cond = cond & category_any_of(categories_col, categories)
    if author:
        cond = cond & text_contains(authors_col, author, case_sensitive)
    if title:
        cond = cond & text_contains(title_col, title, True)
    if start_date or end_date:
        cond = cond & date_in_range(created_col, start_date, end_date)
    return cond


def list_paper_ids(papers: DataFrame, regex_id=None, start_date=None, end_date=None,
                   categories=None, author=None, title=None, *, id_col="base_id",
                   **kw) -> DataFrame:
    """F8: ids of papers passing every given filter (one column, ``id_col``)."""
    pred = paper_predicate(regex_id, start_date, end_date, categories, author, title,
                           id_col=id_col, **kw)
    return papers.where(pred).select(id_col)


def list_ids_sorted(papers: DataFrame, id_col="base_id", **filters) -> DataFrame:
    """Distinct ids passing the filters, sorted (a range-partitioned
    global sort, no single-task step)."""
    return list_paper_ids(papers, id_col=id_col, **filters).distinct().orderBy(id_col)


def versioned_ids(ids: DataFrame, regex_id: str | None, id_col: str = "base_id",
                  keep_columns: bool = False) -> DataFrame:
    """``(base_id, versioned_id)`` rows for a possibly versioned id pattern.

    With ``v<N>`` at the end of the pattern: base ids matching the pattern
    without the suffix, versioned as ``<id>v<N>``, kept when the full pattern
    matches too. Without it: pattern-matching ids with ``v1``. No pattern: all.
    Matching is anchored at the start (Python ``re.match``). ``keep_columns``
    keeps the other columns of ``ids``.
    """
    base_pat, ver, named = split_versioned_pattern(regex_id)
    if keep_columns:
        out = ids if id_col == "base_id" else ids.withColumnRenamed(id_col, "base_id")
    else:
        out = ids.select(F.col(id_col).alias("base_id"))
    if base_pat:
        out = out.where(regex_match("base_id", base_pat))
    out = out.withColumn("versioned_id", with_version("base_id", ver))
    if named:
        out = out.where(regex_match("versioned_id", regex_id))
    return out


def count_papers(papers: DataFrame, start_date=None, end_date=None,
                 created_col="created") -> DataFrame:
    """Number of papers in a date range, one row ``n``."""
    return (papers.where(date_in_range(created_col, start_date, end_date))
            .agg(F.count(F.lit(1)).alias("n")))


def min_class_filter(df: DataFrame, label_col: str, min_count: int = 2) -> DataFrame:
    """Keep rows whose class has at least ``min_count`` rows.

    The class counts come from a partial+final aggregate (a hot class ships one
    row per map task), stored once; the frequent classes are then semi-joined
    back, broadcast when the class table is checked small, shuffled otherwise.
    """
    from .lookup import small_side
    keep = (df.groupBy(label_col).agg(F.count(F.lit(1)).alias("_n"))
            .where(F.col("_n") >= min_count).select(label_col))
    return df.join(small_side(keep), on=label_col, how="left_semi")


def feed_batch_filter(entries: DataFrame, regex_id, start_date, end_date, category,
                      id_col="id", created_col="published_date",
                      categories_col="categories", position: str | None = None) -> DataFrame:
    """feed-batch filter with required start, end and category; the id
    pattern is matched at the start of the id. ``categories_col`` is an array.
    With ``position`` (a total order of the entries), an id that overlapping
    pages repeat keeps its last entry that passes."""
    if not (start_date and end_date and category):
        raise ValueError("start_date, end_date and category are required")
    cats = _as_list(category)
    cond = (date_in_range(created_col, start_date, end_date)
            & F.arrays_overlap(F.col(categories_col), F.array(*[F.lit(c) for c in cats])))
    if regex_id:
        cond = cond & regex_match(id_col, regex_id)
    out = entries.where(cond)
    if not position:
        return out
    return dedup_by_key(materialize(out, "entries"), id_col, position, keep="last")  # the pages are parsed once
