"""The query language, the engine, streams and the driver's contract."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from chartlake.plans import catalog, mql
from chartlake.streaming import streams

ROWS = [(i, [float(i), 0.0], "text" if i % 2 else "image", "c0" if i < 5 else "c1") for i in range(10)]


@pytest.fixture(scope="module")
def engine(spark):
    points = spark.createDataFrame(ROWS, "vec_id long, vector array<double>, modality string, chart string")
    return mql.Engine(spark, {"points": points}, {("text", "image"): ([[1.0, 0.0], [0.0, 1.0]], [3.0, 0.0])}, tangent_dim=1)


def ids(df):
    return [r["vec_id"] for r in df.collect()]


def test_select(engine):
    assert ids(engine.sql("SELECT vec_id FROM points USING metric 'euclidean' WHERE geodesic_distance(vector, [4, 0]) <= 1.5 LIMIT 2")) == [4, 3]
    assert ids(engine.sql("SELECT * FROM points WHERE geodesic_distance(vector, [-1e0, 0.0]) > 8 ORDER BY vec_id DESC")) == [9, 8]
    assert ids(engine.sql("SELECT vec_id FROM points LIMIT 3 ORDER BY vec_id")) == [0, 1, 2]
    assert engine.sql("SELECT vec_id, modality FROM points").columns == ["vec_id", "modality"]


def test_other_statements(engine):
    assert ids(engine.sql("TANGENT_QUERY FROM chart 'c1' NEAR [6, 0] WHERE distance < 1 TOP_K 5")) == [6, 5, 7]
    assert ids(engine.sql("CROSS_MODAL FROM 'text' TO 'image' TRANSPORT VIA 'overlap' NEAR [1, 0] TOP_K 2")) == [4, 2]
    assert engine.sql("PARALLEL_TRANSPORT [1, -2.5] FROM text TO image").first()["vector"] == [4.0, -2.5]
    with pytest.raises(mql.QueryError):
        engine.sql("PARALLEL_TRANSPORT [1] FROM image TO text")


@pytest.mark.parametrize("text", ["", "FETCH x", "SELECT FROM points", "SELECT a FROM points WHERE geodesic_distance(v, [x]) < 1", "SELECT a FROM points WHERE geodesic_distance(v, [1]) < -1", "SELECT a FROM points LIMIT 0", "SELECT a FROM points LIMIT 1.5", "SELECT a FROM points GROUP BY a", "SELECT a FROM $"])
def test_bad_text(text):
    with pytest.raises(mql.QueryError):
        mql.parse(text)


def test_ir_builder_and_cost():
    q = mql.Builder().select("vec_id").from_chart("c0").using_metric("cosine").where_geodesic([1.0, 2.0], 0.5).limit(3).build()
    assert mql.Query.from_dict(q.to_dict()) == q
    assert [mql.Query(chart="c").cost({"c": n}).name for n in (10, 5_000, 10**6)] == ["MODERATE", "EXPENSIVE", "VERY_EXPENSIVE"]
    assert mql.Query(type=mql.QueryType.TANGENT).cost() is mql.CostTier.CHEAP
    for bad in (lambda b: b.top_k(0), lambda b: b.limit(0), lambda b: b.range([1.0], -1).build(), lambda b: b.cross_modal("", "x").build()):
        with pytest.raises(mql.QueryError):
            bad(mql.Builder())


def test_explain_stays_in_the_jvm(engine):
    plan = engine.explain(mql.parse("SELECT vec_id FROM points WHERE geodesic_distance(vector, [4, 0]) < 2 LIMIT 2"))
    assert "TakeOrderedAndProject" in plan and "EvalPython" not in plan and "InArrow" not in plan and "closed form" in plan


def test_streams(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(seconds=10 * i), i % 2, "ab"[i % 2], float(i)) for i in range(40)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    source = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))

    def collect(df, name, mode):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).collect()

    counts = collect(streams.windowed_counts(source(), "1 minute", late="0 seconds"), "counts", "complete")
    assert sum(r["n"] for r in counts) == 40 and len(counts) == 14
    limited = collect(streams.rate_limited(source(), 3, 60.0), "limited", "append")
    assert len(limited) == 40
    for user in (0, 1):
        times = sorted(r["ts"].timestamp() for r in limited if r["user_id"] == user and r["allowed"])
        assert all(sum(t - 60 < x <= t for x in times) <= 3 for t in times) and len(times) >= 18
    means = {r["event_type"]: r["n"] for r in collect(streams.decay_mean(source()), "means", "update")}
    assert means == {"a": 20, "b": 20}

    held = {}

    def write(df, epoch):
        held["df"] = spark.createDataFrame(df.collect(), df.schema)

    apply = streams.upsert_batches(lambda: held.get("df"), write, "user_id")
    for lo in (0, 20):
        apply(spark.read.parquet(str(tmp_path / "in")).where(F.col("event_id").between(lo, lo + 19)), lo)
    assert sorted(r["event_id"] for r in held["df"].collect()) == [38, 39]


def test_sessions_as_batch(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(base + dt.timedelta(minutes=m), 1) for m in (0, 10, 20, 100, 105)]
    out = streams.sessions(spark.createDataFrame(rows, "ts timestamp_ntz, user_id int")).collect()
    assert sorted(r["n"] for r in out) == [2, 3]


def test_contract(spark, sf):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(catalog.QUERIES) > 80


@pytest.mark.parametrize("name", ["knn_batch", "locate_chart", "anchor_search_scored", "knn_graph", "resample_path", "rbf_metric_eval", "export_import_roundtrip", "latency_summary", "chart_path_bfs", "bvp_sphere_distance"])
def test_queries_against_duckdb(spark, sf, name):
    import duckdb

    rows = catalog.QUERIES[name](spark, sf)
    cols = sorted(rows.columns)
    got = rows.select(*cols).collect()
    if name == "bvp_sphere_distance":
        assert all(r["distance"] == pytest.approx(r["great_circle"], rel=1e-6) for r in got)
        return
    con = duckdb.connect()
    for t in ("embeddings", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    cur = con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    want = [tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()]

    def flat(r):
        return tuple(tuple(x) if isinstance(x, list) else x for x in r)

    assert sorted(map(str, map(flat, map(tuple, got)))) == sorted(map(str, map(flat, want)))


def test_transport_chain_rounds_like_its_sql(spark, tmp_path):
    """Coordinates that are multiples of 1/128 end in ties of the sixth decimal."""
    import duckdb

    rows = [(i, [(c + 8 * i - 256) / 128 for c in range(8)] + [0.0] * 56, i % 10) for i in range(64)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalog.QUERIES["transport_chain"](spark, str(tmp_path)).orderBy("vec_id").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert [(r["vec_id"], list(r["moved"])) for r in got] == sorted(con.execute(catalog.ORACLE_SQL["transport_chain"]).fetchall())
