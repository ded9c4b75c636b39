"""Registered queries of the table operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .functions.analyzer import LUCENE_STOPWORDS, Analyzer, analyze
from .operators import index, merge, reads, retention, updates, writes
from .operators.updates import Increment, Other, Overwrite, Put
from .plans.keys import ASCENDING, order, shard_of, with_rank
from .sources.generate import range_load
from .sources.store import Store, scratch
from .spec import TableSpec, make_spec

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

EVENTS = make_spec("events", ["user_id", "ts"], {"time_series": True})
EVENTS_UP = make_spec("events", ["user_id", "ts"], {"time_series": True, "comparator": ASCENDING})
ORDERS = make_spec("orders", ["o_orderkey"])
ORDERS_UP = make_spec("orders", ["o_orderkey"], {"comparator": ASCENDING})
LINES = make_spec("lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"])
LINES_UP = make_spec("lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], {"comparator": ASCENDING})
TALKS = make_spec("conversations", ["conv_id", "turn"], {"comparator": ASCENDING, "hash_exclude": ["turn"]})
DOCUMENTS = make_spec("documents", ["doc_id"], {"comparator": ASCENDING})

_E = "user_id, ts, event_type, value"
_O = "o_orderkey, o_custkey, o_orderstatus, o_totalprice"
_L = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity"
_START = datetime(2024, 1, 20)
_STOP = datetime(2024, 1, 10)
_AS_OF = datetime(2024, 1, 31)


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str, columns: str | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*[c.strip() for c in columns.split(",")]) if columns else df


def _ranked(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Rank of a few limited rows."""
    from pyspark.sql import Window

    return df.withColumn("rn", F.row_number().over(Window.orderBy(*order(spec.key, spec.comparator))).cast("long"))


# points


@query(f"SELECT {_O} FROM orders WHERE o_orderkey = 42")
def read_point(spark, sf_dir):
    return reads.read(_t(spark, sf_dir, "orders", _O), ORDERS, {"o_orderkey": 42})


@query(
    "WITH k(ord, o_orderkey) AS (VALUES (1::BIGINT, 7::BIGINT), (2, 42), (3, -5), (4, 42), (5, 1)) "
    "SELECT k.ord, k.o_orderkey, o.o_custkey, o.o_totalprice, o.o_orderkey IS NOT NULL AS found FROM k LEFT JOIN orders o USING (o_orderkey)"
)
def read_multi_ordered(spark, sf_dir):
    keys = spark.createDataFrame([(1, 7), (2, 42), (3, -5), (4, 42), (5, 1)], "ord long, o_orderkey long")
    return reads.read_multi(_t(spark, sf_dir, "orders", "o_orderkey, o_custkey, o_totalprice"), ORDERS, keys).select("ord", "o_orderkey", "o_custkey", "o_totalprice", "found")


# ranges

_RANGE_LO = {"l_orderkey": 500, "l_partkey": 3, "l_suppkey": 0, "l_linenumber": 0}
_RANGE_HI = {"l_orderkey": 9000, "l_partkey": 100, "l_suppkey": 5, "l_linenumber": 3}
_LK = "l_orderkey, l_partkey, l_suppkey, l_linenumber"


def _beyond_sql(op: str, at: dict) -> str:
    """A tuple comparison written out."""
    names = list(at)
    return "(" + " OR ".join(" AND ".join([*[f"{p} = {at[p]}" for p in names[:i]], f"{k} {op}{'=' if i == len(names) - 1 else ''} {at[k]}"]) for i, k in enumerate(names)) + ")"


_IN_RANGE = f"{_beyond_sql('<', _RANGE_HI)} AND {_beyond_sql('>', _RANGE_LO)}"


@query(f"SELECT {_L}, row_number() OVER (ORDER BY l_orderkey DESC, l_partkey DESC, l_suppkey DESC, l_linenumber DESC, l_quantity DESC) AS rn FROM lineitem WHERE {_IN_RANGE}")
def range_full_desc(spark, sf_dir):
    return with_rank(reads.in_range(_t(spark, sf_dir, "lineitem", _L), LINES, _RANGE_HI, _RANGE_LO), [*LINES.key, "l_quantity"], LINES.comparator)


@query(f"SELECT {_L}, row_number() OVER (ORDER BY {_LK}, l_quantity) AS rn FROM lineitem WHERE {_IN_RANGE}")
def range_full_asc(spark, sf_dir):
    return with_rank(reads.in_range(_t(spark, sf_dir, "lineitem", _L), LINES_UP, _RANGE_LO, _RANGE_HI), [*LINES.key, "l_quantity"], ASCENDING)


_SHARD = "('0x' || substr(sha256(o_orderkey::VARCHAR), 1, 8))::BIGINT % 16"


def _page_sql(direction: str, pick: str, beyond: str, lo: int, hi: int, chunk: int) -> str:
    return (
        f"WITH s AS (SELECT o_orderkey, o_totalprice, {_SHARD} AS shard FROM orders WHERE o_orderkey BETWEEN {lo} AND {hi}), "
        f"r AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY o_orderkey {direction}) AS i FROM s), "
        f"c AS (SELECT {pick}(o_orderkey) AS cont FROM r WHERE i = {chunk + 1}) "
        f"SELECT o_orderkey, o_totalprice, cont AS cont_o_orderkey, row_number() OVER (ORDER BY o_orderkey {direction}) AS rn FROM r, c WHERE i <= {chunk + 1} AND (cont IS NULL OR o_orderkey {beyond} cont)"
    )


@query(_page_sql("DESC", "max", ">", 3000, 9000, 50))
def range_page_chunked(spark, sf_dir):
    page = reads.read_range_page(_t(spark, sf_dir, "orders", "o_orderkey, o_totalprice"), ORDERS, {"o_orderkey": 9000}, {"o_orderkey": 3000}, 50)
    return _ranked(page, ORDERS)


@query(_page_sql("ASC", "min", "<", 3000, 9000, 25))
def range_page_chunked_asc(spark, sf_dir):
    page = reads.read_range_page(_t(spark, sf_dir, "orders", "o_orderkey, o_totalprice"), ORDERS_UP, {"o_orderkey": 3000}, {"o_orderkey": 9000}, 25)
    return _ranked(page, ORDERS_UP)


@query(f"SELECT {_E}, row_number() OVER (ORDER BY user_id DESC, ts DESC) AS rn FROM (SELECT {_E} FROM events WHERE (user_id, ts) <= (7, TIMESTAMP '2024-01-20') ORDER BY user_id DESC, ts DESC LIMIT 100)")
def range_n_desc(spark, sf_dir):
    return _ranked(reads.read_range_n(_t(spark, sf_dir, "events", _E), EVENTS, {"user_id": 7, "ts": _START}, 100), EVENTS)


@query(f"SELECT {_E}, row_number() OVER (ORDER BY user_id, ts) AS rn FROM (SELECT {_E} FROM events WHERE (user_id, ts) >= (7, TIMESTAMP '2024-01-20') ORDER BY user_id, ts LIMIT 100)")
def range_n_asc(spark, sf_dir):
    return _ranked(reads.read_range_n(_t(spark, sf_dir, "events", _E), EVENTS_UP, {"user_id": 7, "ts": _START}, 100), EVENTS_UP)


@query(f"SELECT {_E}, row_number() OVER (ORDER BY ts DESC) AS rn FROM (SELECT {_E} FROM events WHERE user_id = 7 AND ts <= TIMESTAMP '2024-01-20' ORDER BY ts DESC LIMIT 20)")
def range_n_local(spark, sf_dir):
    return _ranked(reads.read_range_n_local(_t(spark, sf_dir, "events", _E), EVENTS, {"user_id": 7, "ts": _START}, 20), EVENTS)


@query(f"SELECT {_E}, row_number() OVER (ORDER BY ts DESC) AS rn FROM (SELECT {_E} FROM events WHERE user_id = 7 AND ts <= TIMESTAMP '2024-01-20' ORDER BY ts DESC LIMIT 20)")
def range_n_ts(spark, sf_dir):
    return _ranked(reads.read_range_n_ts(_t(spark, sf_dir, "events", _E), EVENTS, {"user_id": 7, "ts": _START}, 20), EVENTS)


@query(f"SELECT {_E}, row_number() OVER (ORDER BY ts DESC) AS rn FROM (SELECT {_E} FROM events WHERE user_id = 7 AND ts <= TIMESTAMP '2024-01-20' AND ts >= TIMESTAMP '2024-01-10' ORDER BY ts DESC LIMIT 500)")
def range_n_local_stop(spark, sf_dir):
    return _ranked(reads.read_range_n_local(_t(spark, sf_dir, "events", _E), EVENTS, {"user_id": 7, "ts": _START}, 500, ("ts", _STOP)), EVENTS)


# cursors


@query(f"SELECT {_O} FROM orders ORDER BY o_orderkey DESC LIMIT 1")
def cursor_first(spark, sf_dir):
    return reads.first(_t(spark, sf_dir, "orders", _O), ORDERS)


@query(f"SELECT {_O} FROM orders ORDER BY o_orderkey LIMIT 1")
def cursor_last(spark, sf_dir):
    return reads.last(_t(spark, sf_dir, "orders", _O), ORDERS)


@query(f"SELECT {_O} FROM orders WHERE o_orderkey <= 500 ORDER BY o_orderkey DESC LIMIT 1")
def cursor_seek_hit(spark, sf_dir):
    return reads.seek(_t(spark, sf_dir, "orders", _O), ORDERS, {"o_orderkey": 500})


@query(f"SELECT {_E} FROM events WHERE (user_id, ts) <= (7, TIMESTAMP '2024-01-20 00:00:00.5') ORDER BY user_id DESC, ts DESC LIMIT 1")
def cursor_seek_miss(spark, sf_dir):
    return reads.seek(_t(spark, sf_dir, "events", _E), EVENTS, {"user_id": 7, "ts": datetime(2024, 1, 20, 0, 0, 0, 500000)})


@query(
    "SELECT conv_id, turn, role, lag(turn) OVER w AS prev_turn, lead(turn) OVER w AS next_turn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"
)
def cursor_next_prev(spark, sf_dir):
    return reads.neighbours(_t(spark, sf_dir, "conversations", "conv_id, turn, role"), TALKS)


@query(f"SELECT 'next' AS step, * FROM (SELECT {_O} FROM orders WHERE o_orderkey < 500 ORDER BY o_orderkey DESC LIMIT 1) UNION ALL SELECT 'prev', * FROM (SELECT {_O} FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 1)")
def cursor_steps(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders", _O)
    steps = [("next", reads.after(rows, ORDERS, {"o_orderkey": 500})), ("prev", reads.before(rows, ORDERS, {"o_orderkey": 500}))]
    return steps[0][1].select(F.lit("next").alias("step"), "*").unionByName(steps[1][1].select(F.lit("prev").alias("step"), "*"))


# merging and sorting


@query("SELECT o_orderkey, o_totalprice, CAST(list_no AS INTEGER) AS list_no, row_number() OVER (ORDER BY o_orderkey DESC) AS rn FROM (SELECT *, o_orderkey % 4 AS list_no FROM orders)")
def merge_sorted_shards(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders", "o_orderkey, o_totalprice")
    lists = [rows.where(F.col("o_orderkey") % 4 == i) for i in range(4)]
    return with_rank(merge.tagged_union(lists), ORDERS.key, ORDERS.comparator)


@query("SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey DESC) AS rn FROM customer")
def sort_rows_desc(spark, sf_dir):
    return with_rank(_t(spark, sf_dir, "customer", "c_custkey, c_name"), ["c_custkey"], "descending")


# writes

_WINS = "PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC, l_shipdate DESC, l_extendedprice DESC"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem QUALIFY row_number() OVER ({_WINS}) = 1")
def upsert_last_write_wins(spark, sf_dir):
    newest = [F.desc(c) for c in ("l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")]
    log = _t(spark, sf_dir, "lineitem", "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity")
    return writes.current(log, ["l_orderkey", "l_linenumber"], newest).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS c_name, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal FROM customer")
def upsert_replaces_columns(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer", "c_custkey, c_name, c_acctbal")
    puts = rows.where("c_custkey % 3 = 0").select("c_custkey", (F.col("c_acctbal") * 2).alias("c_acctbal"))
    return writes.upsert(rows, puts, ["c_custkey"])


@query(f"SELECT {_O} FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def delete_keys(spark, sf_dir):
    gone = _t(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return writes.delete(_t(spark, sf_dir, "orders", _O), gone, ORDERS.key)


@query(f"SELECT {_O} FROM orders WHERE o_orderkey NOT IN (1, 7, 42)")
def delete_multi_keys(spark, sf_dir):
    gone = spark.createDataFrame([(1,), (42,), (7,), (42,), (-1,)], "o_orderkey long")
    return writes.delete(_t(spark, sf_dir, "orders", _O), gone, ORDERS.key)


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal AS acctbal, c_mktsegment AS mktsegment, NULL::INTEGER AS nationkey FROM customer UNION ALL SELECT -s_suppkey, s_name, s_acctbal, NULL, s_nationkey FROM supplier")
def dynamic_columns_union(spark, sf_dir):
    a = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("mktsegment"))
    b = _t(spark, sf_dir, "supplier").select((-F.col("s_suppkey")).alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal"), F.col("s_nationkey").alias("nationkey"))
    return writes.write_columns([a, b])


# updates

def _step():
    return F.when(F.col("event_type") == "purchase", 5).when(F.col("event_type") == "click", 1).otherwise(0)


_STEP_SQL = "CASE event_type WHEN 'purchase' THEN 5 WHEN 'click' THEN 1 ELSE 0 END"
_PARTS = "p_partkey, p_name, p_size"


@query(f"SELECT user_id, CAST(sum({_STEP_SQL}) AS BIGINT) AS n FROM events GROUP BY user_id")
def update_increment(spark, sf_dir):
    return updates.fold_increments(_t(spark, sf_dir, "events", "user_id, event_type").withColumn("by", _step()), ["user_id"], "by", name="n")


@query(f"SELECT user_id, CAST(100 + sum({_STEP_SQL}) AS BIGINT) AS n FROM events GROUP BY user_id")
def update_default(spark, sf_dir):
    return updates.fold_increments(_t(spark, sf_dir, "events", "user_id, event_type").withColumn("by", _step()), ["user_id"], "by", start=100, name="n")


@query(f"SELECT user_id, CAST(CASE WHEN tot <= 50 THEN tot ELSE 10 + (tot - 10) % 41 END AS BIGINT) AS n FROM (SELECT user_id, sum({_STEP_SQL}) AS tot FROM events GROUP BY user_id)")
def update_threshold(spark, sf_dir):
    return updates.fold_increments(_t(spark, sf_dir, "events", "user_id, event_type").withColumn("by", _step()), ["user_id"], "by", 0, 50, 10, "n")


@query(f"SELECT user_id, CAST(CASE WHEN tot <= 50 THEN tot ELSE 10 + (tot - 10) % 41 END AS BIGINT) AS n FROM (SELECT user_id, sum({_STEP_SQL}) AS tot FROM events GROUP BY user_id)")
def update_threshold_in_order(spark, sf_dir):
    return updates.fold_increments(_t(spark, sf_dir, "events", "user_id, event_type, ts").withColumn("by", _step()), ["user_id"], "by", 0, 50, 10, "n", "ts")


@query("SELECT p_partkey, p_name, CASE WHEN p_size + 7 > 50 THEN 1 + (p_size + 7 - 50 - 1) ELSE p_size + 7 END AS p_size FROM part")
def update_wrap_once(spark, sf_dir):
    return updates.apply(_t(spark, sf_dir, "part", _PARTS), [Increment("p_size", 7, threshold=50, wrap_to=1)])


_HALF = "CASE WHEN p_size % 2 = 0 THEN p_size END"


@query(f"SELECT p_partkey, p_name, CASE WHEN {_HALF} IS NOT NULL THEN 9 END AS p_size, CASE WHEN {_HALF} IS NULL THEN 'new' ELSE 'new' END AS tag FROM part")
def update_overwrite(spark, sf_dir):
    rows = _t(spark, sf_dir, "part", _PARTS).withColumn("p_size", F.when(F.col("p_size") % 2 == 0, F.col("p_size")))
    return updates.apply(rows, [Overwrite("p_size", 9), Overwrite("missing", 1), Overwrite("tag", "new", "old")])


@query("SELECT p_partkey, p_name, 7 AS p_size, 'x' AS tag FROM part")
def update_put(spark, sf_dir):
    return updates.apply(_t(spark, sf_dir, "part", _PARTS), [Put("p_size", 7), Put("tag", "x")])


@query(f"SELECT p_partkey, p_name, coalesce({_HALF}, 4) + 3 AS p_size, 10 AS other FROM part")
def update_mixed_ignored(spark, sf_dir):
    rows = _t(spark, sf_dir, "part", _PARTS).withColumn("p_size", F.when(F.col("p_size") % 2 == 0, F.col("p_size")))
    return updates.apply(rows, [Increment("p_size", 3, 4), Increment("absent", 3), Increment("p_size", "z"), Other("other", 10), Increment("p_name", "z")])


@query("SELECT p_partkey, p_name, p_size + 1 AS p_size FROM part WHERE p_size > 25")
def update_noop(spark, sf_dir):
    rows = _t(spark, sf_dir, "part", _PARTS)
    new = updates.apply(rows, [Increment("p_size", F.when(F.col("p_size") > 25, 1).otherwise(0))])
    return updates.changed(rows, new, ["p_partkey"])


# index; the time of a document is its id in seconds from 2024

_TS = "(TIMESTAMP '2024-01-01' + to_seconds(doc_id))"
_TOK = (
    "WITH tok AS (SELECT doc_id, unnest(l) AS term, unnest(range(1, len(l) + 1)) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '([\\p{L}\\p{N}]+)', 1) AS l FROM documents)), "
    "post AS (SELECT doc_id, term, count(*) AS freq, min(pos) AS pos FROM tok GROUP BY ALL) "
)


def _texts(spark, sf_dir):
    d = _t(spark, sf_dir, "documents", "doc_id, text, lang")
    return d.withColumn("ts", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, doc_id)"))


def _found(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "ts", "freq", "pos")


def _order_sql(by: str) -> str:
    return f"row_number() OVER (ORDER BY {by}) AS rn"


def _with_rn(df: DataFrame, *by) -> DataFrame:
    from pyspark.sql import Window

    return df.withColumn("rn", F.row_number().over(Window.orderBy(*by)).cast("long"))


@query(_TOK + f"SELECT doc_id, {_TS} AS ts, freq, pos FROM post WHERE term = 'the'")
def index_single_term(spark, sf_dir):
    return _found(index.search(_texts(spark, sf_dir), DOCUMENTS, "text", "The", None, "ts"))


@query(_TOK + f"SELECT doc_id, {_TS} AS ts, min(freq) AS freq, min(pos) AS pos FROM post WHERE term IN ('the', 'that') GROUP BY doc_id HAVING count(*) = 2")
def index_and_terms(spark, sf_dir):
    return _found(index.search(_texts(spark, sf_dir), DOCUMENTS, "text", "the THAT the", None, "ts"))


@query(_TOK + f"SELECT doc_id, {_TS} AS ts, freq, pos FROM post WHERE term = 'und' AND {_TS} BETWEEN TIMESTAMP '2024-01-01 00:01:00' AND TIMESTAMP '2024-01-01 00:10:00'")
def index_filter_ts(spark, sf_dir):
    found = index.search(_texts(spark, sf_dir), DOCUMENTS, "text", "und", None, "ts")
    return _found(index.filtered(found, DOCUMENTS, {"start_ts": datetime(2024, 1, 1, 0, 1), "end_ts": datetime(2024, 1, 1, 0, 10)}))


@query(_TOK + f"SELECT *, {_order_sql('freq DESC, pos DESC, ts DESC, doc_id')} FROM (SELECT doc_id, {_TS} AS ts, freq, pos FROM post WHERE term = 'the' ORDER BY freq DESC, pos DESC, ts DESC, doc_id LIMIT 25)")
def index_max_postings(spark, sf_dir):
    found = index.search(_texts(spark, sf_dir), DOCUMENTS, "text", "the", None, "ts")
    return _with_rn(_found(index.filtered(found, DOCUMENTS, {"max_postings": 25})), F.desc("freq"), F.desc("pos"), F.desc("ts"), "doc_id")


@query(_TOK + f"SELECT *, {_order_sql('ts DESC, doc_id')} FROM (SELECT doc_id, {_TS} AS ts, freq, pos FROM post WHERE term = 'en' ORDER BY ts DESC, doc_id LIMIT 40)")
def index_sort_ts(spark, sf_dir):
    found = index.search(_texts(spark, sf_dir), DOCUMENTS, "text", "en", None, "ts")
    return _with_rn(_found(index.filtered(found, DOCUMENTS, {"sort_by": "timestamp", "max_postings": 40})), F.desc("ts"), "doc_id")


@query(f"SELECT doc_id, {_TS} AS ts, NULL::BIGINT AS freq, NULL::BIGINT AS pos FROM documents WHERE lang = 'fr'")
def index_exact_term(spark, sf_dir):
    return _found(index.search(_texts(spark, sf_dir), DOCUMENTS, "lang", "fr", "exact", "ts"))


_STOPS = ", ".join(f"'{w}'" for w in LUCENE_STOPWORDS)


@query(_TOK + f"SELECT term, count(*) AS documents, CAST(sum(freq) AS BIGINT) AS freq FROM post WHERE term NOT IN ({_STOPS}) GROUP BY term")
def index_stopwords(spark, sf_dir):
    a = Analyzer.of({"token_filter": {"transform": "lowercase", "delete": ["lucene_stopwords"]}})
    return index.postings(_texts(spark, sf_dir), DOCUMENTS, "text", a, "ts").groupBy("term").agg(F.count("*").alias("documents"), F.sum("freq").alias("freq"))


@query(_TOK + "SELECT p.doc_id, p.freq, d.lang, d.source FROM post p JOIN documents d USING (doc_id) WHERE term = 'with'")
def index_search_then_read(spark, sf_dir):
    found = index.search(_texts(spark, sf_dir), DOCUMENTS, "text", "with", None, "ts").select("doc_id", "freq")
    return reads.read_multi(_t(spark, sf_dir, "documents", "doc_id, lang, source"), DOCUMENTS, found).select("doc_id", "freq", "lang", "source")


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '([\\p{L}\\p{N}]+)', 1)) AS BIGINT) + 1 AS n_tokens, lower(regexp_extract_all(text, '([\\p{L}\\p{N}]+)', 1)[1]) AS first_token FROM documents WHERE len(regexp_extract_all(text, '([\\p{L}\\p{N}]+)', 1)) > 0")
def analyzer_tokens(spark, sf_dir):
    a = Analyzer.of({"char_filter": "nfc", "token_filter": {"transform": "lowercase", "add": ["extra"]}})
    tokens = _t(spark, sf_dir, "documents", "doc_id, text").select("doc_id", analyze(F.col("text"), a).alias("t"))
    return tokens.where(F.size("t") > 1).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.col("t")[0].alias("first_token"))


# stored tables: a log of three commits, read as it is and after compaction


def _stored(spark: SparkSession, sf_dir: str) -> tuple[Store, str]:
    rows = _t(spark, sf_dir, "orders", _O)
    store = Store(spark, scratch(spark))
    store.create(ORDERS)
    store.append("orders", rows)
    store.append("orders", rows.where("o_orderkey % 5 = 0").select("o_orderkey", (F.col("o_totalprice") * 2).alias("o_totalprice"), F.lit("twice").alias("note")))
    store.append("orders", rows.where("o_orderkey % 7 = 0").select("o_orderkey"), op=writes.DELETE)
    return store, "orders"


_STORED = (
    "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END AS o_custkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS o_orderstatus, "
    "CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 5 = 0 THEN 'twice' END AS note FROM orders WHERE o_orderkey % 7 <> 0"
)


@query(_STORED)
def stored_current_rows(spark, sf_dir):
    store, name = _stored(spark, sf_dir)
    return store.rows(store.manifest(name))


@query(_STORED)
def stored_compacted_rows(spark, sf_dir):
    store, name = _stored(spark, sf_dir)
    return store.rows(store.compact(name))


def _engine(spark: SparkSession) -> Engine:
    return Engine(spark, scratch(spark))


@query("SELECT * FROM (VALUES (1::BIGINT, 2::BIGINT, 'b'), (2, 20, NULL), (3, NULL, 'c')) t(k, n, s)")
def stored_batch_rows(spark, sf_dir):
    """One commit for a batch; the last request of a key counts, and columns that it lacks are gone."""
    e = _engine(spark)
    e.create_table("t", ["k"])
    e.write_batch([("t", {"k": 1}, {"n": 1}), ("t", {"k": 2}, {"n": 20}), ("none", {"k": 1}, {"n": 1}), ("t", {"k": 1}, {"n": 2, "s": "b"}), ("t", {"k": 3}, {"s": "c"})])
    return e.table("t").select("k", "n", "s")


@query(f"SELECT {_O} FROM orders WHERE o_orderkey NOT IN (1, 7, 42)")
def stored_delete_multi(spark, sf_dir):
    e = _engine(spark)
    e.create_table("orders", ORDERS.key)
    e.write_rows("orders", _t(spark, sf_dir, "orders", _O))
    e.delete_multi("orders", [{"o_orderkey": k} for k in (1, 42, 7, 42, -1)])
    return e.table("orders")


@query(f"SELECT {_E} FROM events WHERE ts >= TIMESTAMP '2024-01-15'")
def stored_fifo_rows(spark, sf_dir):
    """The age half of fifo_ttl: rows written long ago are gone."""
    e, rows = _engine(spark), _t(spark, sf_dir, "events", _E)
    e.create_table("events", EVENTS.key, {"time_series": True, "fifo_ttl": (86_400, 1 << 50)})
    e.store.append("events", rows.where("ts < timestamp_ntz'2024-01-15'"), write_ts=datetime(2020, 1, 1))
    e.store.append("events", rows.where("ts >= timestamp_ntz'2024-01-15'"))
    return e.table("events")


@query(f"SELECT {_E} FROM events WHERE ts >= TIMESTAMP '2024-01-15'")
def stored_ttl_altered(spark, sf_dir):
    e, rows = _engine(spark), _t(spark, sf_dir, "events", _E)
    e.create_table("events", EVENTS.key, {"time_series": True})
    e.store.append("events", rows.where("ts < timestamp_ntz'2024-01-15'"), write_ts=datetime(2020, 1, 1))
    e.store.append("events", rows.where("ts >= timestamp_ntz'2024-01-15'"))
    e.alter_table("events", {"ttl": 86_400})
    e.compact("events")
    return e.table("events")


@query(f"SELECT {_E}, row_number() OVER (ORDER BY ts DESC) AS rn FROM (SELECT {_E} FROM events WHERE user_id = 7 AND ts <= TIMESTAMP '2024-01-20' ORDER BY ts DESC LIMIT 20)")
def stored_range_local(spark, sf_dir):
    """A prefix of a stored table: one shard's files are read."""
    e = _engine(spark)
    e.create_table("events", EVENTS.key, {"time_series": True})
    e.write_rows("events", _t(spark, sf_dir, "events", _E))
    m = e.store.manifest("events")
    start = {"user_id": 7, "ts": _START}
    return _ranked(reads.read_range_n_local(e.store.rows(m, at=start), m.spec, start, 20), m.spec)


@query("SELECT 'backup' AS state, count(*) AS n, sum(o_custkey)::BIGINT AS custkeys FROM orders UNION ALL SELECT 'later', count(*), sum(o_custkey)::BIGINT FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT 'emptied', 0, NULL")
def stored_backup_restore(spark, sf_dir):
    e, rows = _engine(spark), _t(spark, sf_dir, "orders", _O)
    e.create_table("orders", ORDERS.key)
    e.write_rows("orders", rows)
    e.backup("orders")
    e.store.append("orders", rows.where("o_orderkey % 3 = 0").select("o_orderkey"), op=writes.DELETE)
    e.checkpoint("orders")
    sums = lambda state, df: df.agg(F.count("*").alias("n"), F.sum("o_custkey").cast("long").alias("custkeys")).select(F.lit(state).alias("state"), "n", "custkeys")
    later = sums("later", e.table("orders"))
    e.recreate("orders")
    e.write_rows("orders", rows.where("false"))
    emptied = sums("emptied", e.table("orders"))
    e.restore("orders", 1)
    return sums("backup", e.table("orders")).unionByName(later).unionByName(emptied)


_EDITED = (
    "WITH d AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'the NEW text the' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0), "
    "tok AS (SELECT doc_id, unnest(l) AS term, unnest(range(1, len(l) + 1)) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '([\\p{L}\\p{N}]+)', 1) AS l FROM d)), "
    "post AS (SELECT doc_id, term, count(*) AS freq, min(pos) AS pos FROM tok GROUP BY ALL) "
)


def _indexed(spark: SparkSession, sf_dir: str) -> Engine:
    """Documents under a stored index, with overwritten and deleted rows."""
    e, d = _engine(spark), _t(spark, sf_dir, "documents", "doc_id, text, lang")
    e.create_table("documents", DOCUMENTS.key, {"comparator": ASCENDING})
    e.add_index("documents", ["text", ("lang", "exact")])
    e.write_rows("documents", d)
    e.write_rows("documents", d.where("doc_id % 5 = 0").select("doc_id", F.lit("the NEW text the").alias("text"), "lang"))
    e.store.append("documents", d.where("doc_id % 7 = 0").select("doc_id"), op=writes.DELETE)
    return e


@query(_EDITED + "SELECT doc_id, freq, pos FROM post WHERE term = 'the'")
def stored_index_single_term(spark, sf_dir):
    return _indexed(spark, sf_dir).index_rows("documents", "text", "The").select("doc_id", "freq", "pos")


@query(_EDITED + "SELECT doc_id, min(freq) AS freq, min(pos) AS pos FROM post WHERE term IN ('the', 'that') GROUP BY doc_id HAVING count(*) = 2")
def stored_index_and_terms(spark, sf_dir):
    e = _indexed(spark, sf_dir)
    e.compact_index("documents")
    return e.index_rows("documents", "text", "the THAT").select("doc_id", "freq", "pos")


@query("SELECT doc_id FROM documents WHERE lang = 'fr' AND doc_id % 7 <> 0")
def stored_index_exact(spark, sf_dir):
    e = _indexed(spark, sf_dir)
    e.remove_index("documents", ["text"])
    return e.index_rows("documents", "lang", "fr").select("doc_id")


@query(f"SELECT {_O}, lag(o_orderkey) OVER w AS prev_o_orderkey, lead(o_orderkey) OVER w AS next_o_orderkey, row_number() OVER w AS rn FROM orders WINDOW w AS (ORDER BY o_orderkey DESC)")
def cursor_walk(spark, sf_dir):
    return reads.neighbours_all(_t(spark, sf_dir, "orders", _O), ORDERS)


@query("SELECT c_name, c_custkey, row_number() OVER (ORDER BY c_name DESC, c_custkey DESC) AS rn FROM customer")
def rank_string_key(spark, sf_dir):
    return with_rank(_t(spark, sf_dir, "customer", "c_name, c_custkey"), ["c_name", "c_custkey"], "descending", rows_per_bucket=200)


@query("SELECT n.x AS ts, 123::BIGINT AS value, 23::BIGINT AS incs FROM range(20000) n(x)")
def load_generator(spark, sf_dir):
    return range_load(spark, 20_000).where(F.col("key").between(1, 10_000)).select("ts", "value", "incs")


# retention and statistics


@query("SELECT event_id, user_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-31' - INTERVAL 604800 SECONDS")
def ttl_live_rows(spark, sf_dir):
    return retention.live(_t(spark, sf_dir, "events", "event_id, user_id, ts"), "ts", 604800, F.lit(_AS_OF).cast("timestamp_ntz"))


@query(
    "WITH s AS (SELECT event_id, user_id, ts, ('0x' || substr(sha256(user_id::VARCHAR), 1, 8))::BIGINT % 16 AS shard FROM events), "
    "h AS (SELECT *, sum(100) OVER (PARTITION BY shard ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS held FROM s) "
    "SELECT event_id, user_id, ts FROM h WHERE held <= 200000 // 16"
)
def fifo_retention(spark, sf_dir):
    rows = _t(spark, sf_dir, "events", "event_id, user_id, ts")
    return retention.fifo(rows, shard_of(["user_id"], 16), [F.desc("ts"), F.desc("event_id")], F.lit(100), 200_000, 16, F.shiftright(F.unix_micros(F.col("ts").cast("timestamp")), 32))


@query("SELECT count(DISTINCT o_orderkey) AS num_keys FROM orders")
def num_keys(spark, sf_dir):
    return retention.num_keys(_t(spark, sf_dir, "orders"), ORDERS.key)


@query("SELECT CAST(('0x' || substr(sha256(o_orderkey::VARCHAR), 1, 8))::BIGINT % 16 AS INTEGER) AS shard, count(*) AS n FROM orders GROUP BY 1")
def shard_distribution(spark, sf_dir):
    return retention.shard_counts(_t(spark, sf_dir, "orders"), shard_of(ORDERS.hash_key, ORDERS.num_of_shards))


_INFO = ("columns", "comparator", "data_model", "hash_key", "key", "name", "num_of_shards", "time_series")


@query("SELECT * FROM (VALUES ('columns', 'event_type,value'), ('comparator', 'descending'), ('data_model', 'array'), ('hash_key', 'user_id'), ('key', 'user_id,ts'), ('name', 'events'), ('num_of_shards', '16'), ('time_series', 'true')) t(property, value)")
def table_info_props(spark, sf_dir):
    """Asked of a table that was created and written; names that are no property are left out."""
    e = _engine(spark)
    e.create_table("events", EVENTS.key, {"time_series": True})
    e.write_rows("events", _t(spark, sf_dir, "events", _E).limit(10))

    def text(v) -> str:
        return ",".join(v) if isinstance(v, tuple) else str(v).lower() if isinstance(v, bool) else str(v)

    return spark.createDataFrame([(p, text(v)) for p, v in e.table_info("events", [*_INFO, "nonsense"]).value], "property string, value string")


@query("SELECT * FROM (VALUES ('keys_within_5_percent', 1::BIGINT), ('size_is_positive', 1)) t(property, value)")
def table_info_measured(spark, sf_dir):
    e, rows = _engine(spark), _t(spark, sf_dir, "orders", "o_orderkey")
    e.create_table("orders", ORDERS.key)
    e.write_rows("orders", rows)
    found, n = dict(e.table_info("orders", ["size", "approx_num_keys"]).value), rows.count()
    return spark.createDataFrame([("keys_within_5_percent", int(abs(found["approx_num_keys"] - n) <= 0.05 * n)), ("size_is_positive", int(found["size"] > 0))], "property string, value long")


@query("SELECT * FROM (VALUES ('conversations'), ('documents'), ('events'), ('lineitem')) t(name)")
def list_tables(spark, sf_dir):
    """The catalog after five tables were created and one deleted."""
    e = _engine(spark)
    for s in (EVENTS, ORDERS, LINES, TALKS, DOCUMENTS):
        e.store.create(s)
    e.delete_table("orders")
    return spark.createDataFrame([(n,) for n in e.list_tables()], "name string")
