"""Relational operators on micro fixtures, and two formulations of the same answer."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tritlake.functions import fields
from tritlake.functions.grid import Grid
from tritlake.operators import extend, retrieve, score, train, vote
from tritlake.plans import sql
from tritlake.plans.index import Index
from tritlake.plans.queries import QUERIES, _sigs
from tritlake.sources.images import VECTOR_GRID, read_idx, vectors_as_images

SF = "/root/testdata/sf0.001"


def votes(spark):
    rows = [(1, t, 0, v) for t, v in ((1, 5), (2, 3), (3, 3), (4, 3), (5, 9), (6, 0))]
    return spark.createDataFrame(rows, "qid int, tid int, tlabel int, votes int")


def test_top_k_exact_and_by_threshold(spark):
    exact = [r.tid for r in retrieve.top_exact(votes(spark), 3).orderBy("rank").collect()]
    assert exact == [5, 1, 2]
    # The threshold is 3; the first three in id order that reach it leave out the best.
    quirk = [r.tid for r in retrieve.top_threshold_id(votes(spark), 3).orderBy("rank").collect()]
    assert quirk == [1, 2, 3]
    assert retrieve.top_threshold_id(votes(spark), 10).count() == 5


def test_ties_go_to_the_lowest_class(spark):
    d = spark.createDataFrame([(1, 7, c, p) for p, c in enumerate((4, 2, 9), 1)], "qid int, label int, tlabel int, place int")
    assert vote.knn(d, 3).first().pred == 2


def test_spread_of_few_candidates_is_the_default(spark):
    d = spark.createDataFrame([(1, 5), (1, 6), (2, 1), (2, 1), (2, 1), (3, 1), (3, 4), (3, 9)], "qid int, ns int")
    assert {r.qid: r.mad for r in score.spread(d).collect()} == {1: 1000, 2: 1, 3: 3}


def test_recurrence_against_plain_python(spark):
    rows = [(1, 0, c, p, ev * 256) for p, (c, ev) in enumerate([(3, -5), (1, 7), (3, 40), (0, -9)], 1)]
    h = [0] * 10
    trunc = lambda a, b: -(-a // b) if a < 0 else a // b
    for _, _, c, _, e in rows:
        h = [trunc(v * 3 + (2 * trunc(e, 256) if k == c else -10), 4) for k, v in enumerate(h)]
    got = vote.recurrent(spark.createDataFrame(rows, "qid int, label int, tlabel int, place int, combined long")).first().h
    assert got == h


def test_kernel_and_join_agree(spark):
    i = Index.fit(vectors_as_images(spark, SF), VECTOR_GRID)
    key = lambda d: sorted((r.qid, r.tid, r.votes) for r in d.select("qid", "tid", "votes").collect())
    assert key(i.votes()) == key(i.kernel())
    assert key(retrieve.top_exact(i.votes(), 7)) == key(i.kernel(7))
    j = Index.fit(vectors_as_images(spark, SF), VECTOR_GRID, joint=True, probe="bitflip")
    assert key(retrieve.top_exact(j.votes(), 7)) == key(j.kernel(7))


def test_the_number_of_partitions_does_not_matter(spark):
    def run(n):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        return sorted(map(tuple, Index.fit(vectors_as_images(spark, SF), VECTOR_GRID).retrieve(20).score().vote().collect()))

    try:
        assert run(1) == run(7)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_idx_files(spark, tmp_path):
    body = bytes(range(12))
    (tmp_path / "img").write_bytes(bytes([0, 0, 8, 3, 0, 0, 0, 2, 0, 0, 0, 2, 0, 0, 0, 3]) + body)
    (tmp_path / "lab").write_bytes(bytes([0, 0, 8, 1, 0, 0, 0, 2, 4, 9]))
    assert [r.value for r in read_idx(spark, str(tmp_path / "img")).orderBy("id").collect()] == [list(range(6)), list(range(6, 12))]
    assert [r.value for r in read_idx(spark, str(tmp_path / "lab")).orderBy("id").collect()] == [[4], [9]]


def test_bucket_bounds_are_places_in_the_sorted_values(spark):
    v = [5, 1, 1, 1, 9, 7, 7, 2]
    d = spark.createDataFrame([(x,) for x in v], "v int")
    assert [r.bound for r in train.bucket_bounds(d, "v", 4).orderBy("bucket").collect()] == [sorted(v)[k * 8 // 4] for k in (1, 2, 3)]


@pytest.mark.parametrize("name", ["hotmap_classify", "info_gain", "vote_multiprobe", "topk_threshold_id", "joint_byte", "divergence", "knn_vote", "fusion_borda", "enclosed_centroid"])
def test_queries_equal_their_sql(spark, name):
    c = duckdb.connect()
    for t in ("embeddings", "lineitem"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    b = c.sql(sql.ORACLE_SQL[name])
    a = QUERIES[name](spark, SF)
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    assert sorted(map(tuple, a.select(*cols).collect())) == sorted(b.select(*cols).fetchall())


def test_stream_scoring_equals_batch(spark, tmp_path):
    from tritlake.streaming.scoring import score_stream

    images = vectors_as_images(spark, SF)
    i = Index.fit(images, VECTOR_GRID)
    q = images.filter("is_query")
    q.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(q.schema).parquet(str(tmp_path / "in"))
    run = score_stream(stream, VECTOR_GRID, i.hot, i.bg, str(tmp_path / "out"), str(tmp_path / "state"))
    run.processAllAvailable()
    run.stop()
    want = sorted(map(tuple, vote.argmax(vote.hot_scores(i.sigs, i.hot, i.bg), "score", keys=("qid", "label")).collect()))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("qid", "label", "pred").collect())) == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["qid", "label", "pred"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_distance_fields_against_all_edges(spark):
    g = Grid(5, 4)
    planes = [[1] * 20, [-1] * 20, [1 if k % 5 < 3 else -1 for k in range(20)], [0 if k == 7 else -1 for k in range(20)]]
    d = spark.createDataFrame(list(enumerate(planes)), "id int, t array<int>")
    got = {r.id: r for r in d.select("id", fields.signed_distance(g, F.col("t")).alias("s"), fields.edge_distance(g, F.col("t")).alias("e")).collect()}

    def plain(t, alone, differs, side):
        cells = [(k // 5, k % 5) for k in range(20)]
        near = lambda a, b: abs(a[0] - b[0]) + abs(a[1] - b[1])
        edges = [c for c, v in zip(cells, t) if alone(v) or any(near(c, o) == 1 and differs(v, u) for o, u in zip(cells, t))]
        return [max(-128, min(127, side(v) * min((near(c, o) for o in edges), default=999))) for c, v in zip(cells, t)]

    for k, t in enumerate(planes):
        assert got[k].s == plain(t, lambda v: v == 0, lambda v, u: v != u, lambda v: -1 if v > 0 else 1 if v < 0 else 0)
        assert got[k].e == plain(t, lambda v: False, lambda v, u: (v == 0) != (u == 0), lambda v: -1 if v else 1)


def test_principal_components_against_a_library(spark):
    x = np.random.default_rng(1).integers(-1, 2, (60, 6)) * [3, 1, 1, 2, 1, 1]
    d = spark.createDataFrame([(False, r.tolist()) for r in x], "is_query boolean, t array<int>")
    mean, comps = extend.principal_components(d, 6, 2, 2000)
    assert np.allclose(mean, x.mean(axis=0))
    true = np.linalg.eigh(np.cov(x.T, bias=True))[1][:, ::-1].T[:2]
    assert np.allclose(np.abs((comps * true).sum(axis=1)), 1, atol=1e-6)
    none = extend.principal_components(d.limit(0), 6, 2)
    assert np.isfinite(none[1]).all()


def test_propagation_waves_and_no_anchor(spark):
    t = spark.createDataFrame([(1, [1, 1, 1]), (2, [1, 1, 0]), (3, [-1, 0, -1]), (4, [-1, -1, -1])], "id int, t array<int>")
    p = spark.createDataFrame([(1, 5, 9), (2, 7, 1), (3, 7, 1), (4, 2, 9)], "qid int, pred int, agree int")
    got = {(r.qid, r.pred, r.wave) for r in extend.propagate(t, p, 9, k=1, agree=1).collect()}
    assert got == {(1, 5, 0), (2, 5, 1), (3, 2, 1), (4, 2, 0)}
    assert {(r.qid, r.pred) for r in extend.propagate(t, p, 10).collect()} == {(1, 5), (2, 7), (3, 7), (4, 2)}


def test_pair_gains_of_all_labels(spark):
    got = {(r.a, r.b, r.pos): r.w for r in QUERIES["pair_info_gain"](spark, SF).filter("channel = 'px'").collect()}
    assert {(a, b) for a, b, _ in got} == {(a, b) for a in range(10) for b in range(a + 1, 10)}
    # One pair on its own, with the background of all labels.
    s = _sigs(spark, SF).filter("channel = 'px'")
    own = train.gain(train.hot_map(s.filter("label in (4, 9)")), train.background(s)).collect()
    assert own and {r.pos: r.w for r in own} == {pos: w for (a, b, pos), w in got.items() if (a, b) == (4, 9)}
