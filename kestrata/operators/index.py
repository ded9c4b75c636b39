"""The inverted index: postings of analysed columns, term search and posting filters.

A posting is (key fields, ts, freq, pos): how often a term occurs in a row's
column and where first (from 1).  Postings derive from the current rows, so
deletes and overwrites need no upkeep; wanted terms are filtered in the token
array, before it is exploded.  Stored tables keep the postings of each commit
(``Store.postings``), and ``ranked`` combines them.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import TableError
from ..functions.analyzer import Analyzer, analyze
from ..spec import TableSpec

FILTERS = ("sort_by", "start_ts", "end_ts", "max_postings")


def postings(rows: DataFrame, spec: TableSpec, column: str, analyzer: Analyzer, ts: str | None = None, terms: list[str] | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """Key fields, term, freq, pos and ts (null without a time column) of every term, or of ``terms`` only; with the columns ``more`` of the rows."""
    stamp = F.col(ts) if ts else F.lit(None).cast("timestamp")
    tokens = analyze(F.col(column), analyzer)
    base = rows.where(F.col(column).isNotNull())
    held = (*spec.key, *more)
    if terms is None:
        base = base.select(*held, stamp.alias("ts"), F.posexplode(tokens).alias("__at", "term"))
    else:
        placed = F.filter(F.transform(tokens, lambda t, i: F.struct(i.alias("at"), t.alias("term"))), lambda x: x.term.isin(terms))
        base = base.select(*held, stamp.alias("ts"), F.explode(placed).alias("__t")).select(*held, "ts", F.col("__t.at").alias("__at"), "__t.term")
    stats = analyzer.stats and not analyzer.exact
    freq, pos = (F.count("*").cast("long"), (F.min("__at") + 1).cast("long")) if stats else (F.lit(None).cast("long"), F.lit(None).cast("long"))
    hits = base.groupBy(*held, "ts", "term")
    return hits.agg(freq.alias("freq"), pos.alias("pos")) if stats else hits.agg(F.count("*").alias("__n")).select(*held, "ts", "term", freq.alias("freq"), pos.alias("pos"))


def query_terms(rows: DataFrame, text: str, analyzer: Analyzer) -> list[str]:
    """The distinct terms of a query, analysed like the column, in order."""
    if analyzer.exact:
        return [text]
    spark = rows.sparkSession
    found = spark.range(1).select(analyze(F.lit(text), analyzer.for_query()).alias("t")).first().t
    return list(dict.fromkeys(found))


def search(rows: DataFrame, spec: TableSpec, column: str, text: str, options: Mapping[str, Any] | str | None, ts: str | None = None) -> DataFrame:
    """Postings of the rows that have every term of the query, best first: freq, pos and ts descending, then the key."""
    a = Analyzer.of(options)
    terms = query_terms(rows, text, a)
    return ranked(postings(rows, spec, column, a, ts, terms or [""]), spec, terms)


def ranked(found: DataFrame, spec: TableSpec, terms: list[str]) -> DataFrame:
    """Postings of the keys that have all the terms, best first."""
    if not terms:
        found = found.where(F.lit(False))
    if len(terms) == 1:
        found = found.drop("term")
    else:
        place = F.element_at(F.create_map(*[x for i, t in enumerate(terms or [""]) for x in (F.lit(t), F.lit(i))]), F.col("term"))
        found = found.groupBy(*spec.key).agg(F.count("*").alias("__n"), F.min("freq").alias("freq"), F.min("pos").alias("pos"), F.max_by("ts", place).alias("ts")).where(F.col("__n") == len(terms)).drop("__n")
    return found.select(*spec.key, "ts", "freq", "pos").orderBy(F.desc("freq"), F.desc("pos"), F.desc("ts"), *spec.key)


def filtered(found: DataFrame, spec: TableSpec, how: Mapping[str, Any] | None) -> DataFrame:
    """Posting filters in their fixed order: sort_by timestamp, start_ts, end_ts, max_postings."""
    how = dict(how or {})
    if set(how) - set(FILTERS):
        raise TableError((sorted(set(how) - set(FILTERS))[0], "invalid_filter"))
    by = [F.desc("freq"), F.desc("pos"), F.desc("ts"), *spec.key]
    if how.get("sort_by") == "timestamp":
        by = [F.desc("ts"), *spec.key]
    if how.get("start_ts") is not None:
        found = found.where(F.col("ts") >= F.lit(how["start_ts"]))
    if how.get("end_ts") is not None:
        found = found.where(F.col("ts") <= F.lit(how["end_ts"]))
    found = found.orderBy(*by)
    n = how.get("max_postings")
    return found.limit(n) if isinstance(n, int) and not isinstance(n, bool) and n > 0 else found
