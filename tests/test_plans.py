"""Plans that the queries must keep: pushed bounds, pruned columns, limits that don't sort everything."""

from kestrata.queries import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bounds_reach_the_scan(spark, sf_dir):
    p = plan(QUERIES["range_n_desc"](spark, sf_dir))
    assert "PushedFilters: [" in p and "LessThan" in p.split("PushedFilters")[1].split("]")[0]
    assert "TakeOrderedAndProject" in p


def test_point_reads_only_its_columns(spark, sf_dir):
    p = plan(QUERIES["read_point"](spark, sf_dir))
    assert "EqualTo(o_orderkey,42)" in p and "o_orderpriority" not in p.split("ReadSchema")[1]


def test_upserts_limit_before_the_shuffle(spark, sf_dir):
    assert "WindowGroupLimit" in plan(QUERIES["upsert_last_write_wins"](spark, sf_dir))


def test_counters_combine_before_the_shuffle(spark, sf_dir):
    assert "partial_sum" in plan(QUERIES["update_threshold"](spark, sf_dir))


def _plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_point_reads_and_postings_prune_files(spark, sf_dir, tmp_path):
    from kestrata.engine import Engine
    from kestrata.operators import reads

    e = Engine(spark, str(tmp_path / "tables"))
    e.create_table("d", ["doc_id"])
    e.add_index("d", ["text"])
    e.write_rows("d", spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    m = e.store.manifest("d")
    point = _plan(reads.read(e.store.rows(m, at={"doc_id": 7}), m.spec, {"doc_id": 7}))
    assert "PartitionFilters: [isnotnull(_shard" in point and "EqualTo(doc_id,7)" in point
    found = _plan(e.index_rows("d", "text", "the"))
    assert "_bucket" in found.split("PartitionFilters")[1].split("]")[0] and "EqualTo(term,the)" in found


def test_ranks_by_buckets_of_whole_keys(spark):
    from kestrata.plans.keys import with_rank

    rows = [("hot" if i % 3 else f"k{i % 50:02d}", i * 7 % 1000) for i in range(1000)]
    for comparator in ("ascending", "descending"):
        out = {(r.a, r.b): r.rn for r in with_rank(spark.createDataFrame(rows, "a string, b int").repartition(4), ["a", "b"], comparator, rows_per_bucket=60).collect()}
        assert out == {k: i + 1 for i, k in enumerate(sorted(rows, reverse=comparator == "descending"))}


def test_ranks_find_a_bucket_by_halving(spark):
    from kestrata.plans.keys import with_rank

    rows = [(None if i % 50 == 0 else i * 7919 % 1000, i) for i in range(700)]
    df = spark.createDataFrame(rows, "a long, b long")
    for comparator in ("ascending", "descending"):
        for per in (2, 100, 300):
            out = with_rank(df, ["a", "b"], comparator, rows_per_bucket=per)
            order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=comparator == "descending")
            assert [(r.a, r.b) for r in sorted(out.collect(), key=lambda r: r.rn)] == order
            # a step for each power of two of buckets, not a comparison for each bound
            plan = out._jdf.queryExecution().optimizedPlan().toString()
            assert "filter(__bounds" not in plan and "aggregate([" in plan


def test_texts_are_normalised_once_and_ascii_not_at_all(spark, sf_dir):
    import pyarrow as pa
    from pyspark.sql import functions as F

    from kestrata.functions.analyzer import Analyzer, analyze, normalize, _parts
    from kestrata.operators import index
    from kestrata.spec import make_spec

    assert plan(QUERIES["analyzer_tokens"](spark, sf_dir)).count("ArrowEvalPython") == 1
    df = spark.createDataFrame([(1, "Café STRASSE"), (2, "plain"), (3, None), (4, "Straße"), (5, "")], "k long, t string")
    assert [r.n for r in df.select("k", normalize(F.col("t"), "nfc").alias("n")).sort("k").collect()] == ["Café STRASSE", "plain", None, "Straße", ""]
    a = Analyzer.of({"char_filter": "nfc", "token_filter": {"transform": "casefold"}})
    assert [r.n for r in df.select("k", analyze(F.col("t"), a).alias("n")).sort("k").collect()] == [["café", "strasse"], ["plain"], None, ["strasse"], []]
    for terms in (None, ["strasse"]):
        found = index.postings(df, make_spec("d", ["k"]), "t", a, terms=terms)
        assert {(r.k, r.freq) for r in found.where("term = 'strasse'").collect()} == {(1, 1), (4, 1)}
    assert sum(len(p) for p in _parts(pa.array(["x" * 100_000] * 50))) == 50 and max(p.nbytes for p in _parts(pa.array(["x" * 100_000] * 50))) <= 1 << 20
