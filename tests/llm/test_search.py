"""Vector searches against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.llm import ann, topk
from chronoweave.llm.vectors import Best


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("rank", F.lit(2))


def brute(rows, queries, k, product):
    usable = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for q in sorted({i for i, _ in queries}):
        for v in (v for i, v in usable if i == q):
            scored = {}
            for i, x in usable:
                if i != q and len(x) == len(v) and (s := product(v, x)) is not None:
                    scored[i] = max(scored.get(i, s), s)
            out[q] = sorted(scored.items(), key=lambda p: (-p[1], p[0]))[:k]
    return out


def cosine(a, b):
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return float(a @ b) / n if n else None


ODD = [
    (0, [1.0, 0.0, 0.0]), (1, [1.0, 0.1, 0.0]), (2, [1.0, 0.1, 0.0]), (3, [-1.0, 0.0, 0.0]), (4, [0.0, 0.0, 0.0]), (5, None), (6, [1.0, None, 0.0]),
    (7, [float("nan"), 1.0, 0.0]), (8, [float("inf"), 1.0, 0.0]), (9, [0.5, 0.5, 0.5]), (10, [2.0, 0.2, 0.0]), (11, []), (None, [1.0, 0.0, 0.0]), (12, [1.0, 2.0]),
    (13, [1e-200, 0.0, 0.0]), (14, [1e200, 1e200, 0.0]),
]


def ranked(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_neighbours_of_odd_vectors(spark):
    t = table(spark, ODD)
    got = ranked(ann.nearest(t, t.where("vec_id in (0, 3, 4, 5, 9, 12)"), k=20, chance=1.0))
    big = [(i, [x / 1e200 if x else x for x in v] if i == 14 else [x * 1e200 for x in v] if i == 13 else v) for i, v in ODD]
    expected = brute([r for r in big if r[0] not in (4, 12)], [(0, 0), (3, 0), (9, 0)], 20, cosine)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in expected.items()}
    for q, v in got.items():
        assert [s for _, s in v] == pytest.approx([s for _, s in expected[q]], abs=1e-12)


def test_products_of_odd_vectors(spark):
    rows = [(i, v) for i, v in ODD if i != 14]
    t = table(spark, rows)
    got = ranked(topk.top_products(t, t.where("vec_id in (0, 3, 4, 5, 9)"), k=4))
    quantised = [(i, v and [x if x is None or not np.isfinite(x) else float(np.floor(256 * x)) for x in v]) for i, v in rows]
    expected = brute([r for r in quantised if r[0] != 12], [(0, 0), (3, 0), (4, 0), (9, 0)], 4, lambda a, b: int(a @ b))
    assert got == expected


def test_products_of_large_components_are_exact(spark):
    """Beyond 2^53 in sums of doubles, and with components beyond 2^28."""
    rows = [(0, [2e6, 1.0]), (1, [2e6, 1.0]), (2, [1.5e6, 1.0]), (3, [1e6 + 1 / 256, -1.0]), (4, [1e7, 3.0]), (5, [-3.5e6, 1e9]), (6, [4.0, 5.0])]
    rows += [(10 + i, [float(i), 1e6 - i]) for i in range(60)]
    t = table(spark, rows).repartition(3)
    got = ranked(topk.top_products(t, t.where("vec_id in (0, 3, 6)")))
    whole = {i: [int(256 * x) for x in v] for i, v in rows}
    for q in (0, 3, 6):
        scores = sorted(((-sum(a * b for a, b in zip(whole[q], whole[i])), i) for i in whole if i != q))[:5]
        assert got[q] == [(i, -s) for s, i in scores]
    assert got[0][1] == (1, 262144000000065536)
    far = table(spark, [(0, [1e200, 1.0]), (1, [1.0, 0.0])])
    with pytest.raises(Exception, match="does not fit a long"):
        topk.top_products(far, far.where("vec_id = 0")).collect()


def test_lists_are_not_read_to_their_ends():
    r = np.random.default_rng(6)
    v = r.standard_normal((4096, 64))
    rows = np.floor(256 * v / np.linalg.norm(v, axis=1, keepdims=True))
    block, left = topk.SortedBlock(np.arange(4096), rows), []
    for q in range(0, 4096, 400):
        scores = np.sort(np.delete(rows @ rows[q], q))[::-1]
        ids, found = block.best(rows[q], q, 5, int(0.95 * scores[4]))
        left.append(len(ids))
        assert sorted(found.tolist(), reverse=True)[:5] == scores[:5].tolist()
    assert block.read < 0.85 * 11 * rows.size and np.mean(left) < 0.1 * 4096
    skipped = block.read
    assert len(block.best(rows[0], 0, 5, 10**9)[0]) == 0 and block.read == skipped  # its best values do not reach the bound


def test_each_dimension_is_searched(spark):
    r = np.random.default_rng(7)
    rows = [(i, r.integers(-9, 9, 2 + i % 3).astype(float).tolist()) for i in range(90)]
    t = table(spark, rows).repartition(3)
    asked = [x for x in rows if x[0] % 10 == 0]
    assert ranked(topk.top_products(t, t.where("vec_id % 10 = 0"))) == brute([(i, [256 * x for x in v]) for i, v in rows], asked, 5, lambda a, b: int(a @ b))


def test_empty_tables(spark):
    t = table(spark, ODD)
    for search in (ann.nearest, topk.top_products):
        assert search(t.where("false"), t.where("false")).count() == 0
        assert search(t, t.where("false")).count() == 0


def test_few_candidates_and_repeated_rows(spark):
    t = table(spark, [(0, [1.0, 0.0]), (1, [1.0, 0.5]), (1, [1.0, 0.5]), (0, [1.0, 0.0])])
    assert [i for i, _ in ranked(ann.nearest(t, t.where("vec_id = 0"), chance=1.0))[0]] == [1]
    assert ranked(topk.top_products(t, t.where("vec_id = 0")))[0] == [(1, 65536)]


@pytest.mark.parametrize("size", [4096, 16])
def test_repeated_rows_take_no_places(spark, monkeypatch, size):
    monkeypatch.setattr(topk, "ROWS", size)
    monkeypatch.setattr(ann, "BLOCK", size)
    r = np.random.default_rng(5)
    rows = [(i, r.integers(-8, 9, 6).tolist()) for i in range(60)]
    rows += [(i, v) for i, v in rows[:30] for _ in range(7)]  # copies, more than k
    rows += [(i, r.integers(-8, 9, 6).tolist()) for i in range(10, 60) for _ in range(3)]  # one id, other vectors
    rows = [(i, [float(x) for x in v]) for i, v in rows]
    t = table(spark, rows).repartition(3)
    asked = [x for x in rows if x[0] in (0, 3, 7)]
    products = brute([(i, [256 * x for x in v]) for i, v in rows], asked, 5, lambda a, b: int(a @ b))
    assert ranked(topk.top_products(t, t.where("vec_id in (0, 3, 7)"))) == products
    got, near = ranked(ann.nearest(t, t.where("vec_id in (0, 3, 7)"), chance=1.0)), brute(rows, asked, 5, cosine)
    for q in near:
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in near[q]], abs=1e-12) and len({i for i, _ in got[q]}) == 5


def test_best_counts_an_id_once():
    best = Best(3)
    best.add(np.array([7] * 5), np.array([1, 2, 1, 2, 3]), np.array([9.0, 8.0, 7.0, 6.0, 5.0]))
    assert best.cut()[1].tolist() == [1, 2, 3]


def test_recall_and_exact_scores(spark, data):
    t = spark.read.parquet(f"{data}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in t.collect()]
    asked = [r for r in rows if r[0] % 50 == 0]
    expected = brute(rows, asked, 5, cosine)
    got = ranked(ann.nearest(t, t.where("vec_id % 50 = 0")))
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in expected[q]}) for q in expected)
    assert hits >= 0.9 * 5 * len(expected)
    of = {i: np.array(v) for i, v in rows}
    for q, found in got.items():
        for i, s in found:
            assert s == pytest.approx(cosine(of[q], of[i]), abs=1e-12)


def test_probes_come_by_falling_chance_and_cover_it():
    r = np.random.default_rng(8)
    for k in (1, 2, 5, 8):
        hashes = ann.Hashes.make(max(k, 2), 1, k)
        chances = ann.slot_chances(r.standard_normal((1, hashes.borders.shape[1])), hashes.borders[0])[0]
        assert chances.sum(axis=1) == pytest.approx(1)
        every = {}
        for slots in np.ndindex(*[chances.shape[1]] * len(chances)):
            every[sum(s * chances.shape[1] ** d for d, s in enumerate(slots))] = np.prod([chances[d, s] for d, s in enumerate(slots)])
        found = list(ann.probes(chances, 0.8))
        assert len(set(found)) == len(found) and np.diff([every[c] for c in found]).max(initial=0) <= 1e-12
        assert sum(every[c] for c in found) >= 0.8 > sum(every[c] for c in found[:-1])
        assert min(every[c] for c in found) >= max((p for c, p in every.items() if c not in set(found)), default=0) - 1e-12
        assert sorted(ann.probes(chances, 2.0)) == sorted(every)


@pytest.mark.parametrize("clustered, cosine, share", [(False, ann.COSINE, 0.95), (True, 0.8, 0.3)])
def test_fewer_comparisons_than_a_scan(data, clustered, cosine, share):
    """Comparisons a query, copies in several tables counted each time, and the recall that they give."""
    r = np.random.default_rng(9)
    if clustered:
        v = r.standard_normal((40, 64))[r.integers(0, 40, 3000)] + 0.4 * r.standard_normal((3000, 64))
    else:
        import pyarrow.parquet as pq

        v = np.stack(pq.read_table(f"{data.replace('0.001', '0.1')}/embeddings.parquet").column("embedding").to_pylist()).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    hashes = ann.Hashes.make(64)
    projections = hashes.projections(v)
    codes, made, hits, asked = hashes.codes(projections), 0, 0, range(0, len(v), 50)
    for q in asked:
        seen = np.zeros(len(v), bool)
        for t in range(len(codes)):
            visited = np.zeros(hashes.buckets * len(codes), bool)
            visited[np.fromiter(ann.probes(ann.slot_chances(projections[t, [q]], hashes.borders[t], cosine)[0]), np.int64) + t * hashes.buckets] = True
            made += visited[codes[t]].sum()
            seen |= visited[codes[t]]
        near = v @ v[q]
        near[q] = -2
        hits += seen[np.argsort(-near)[:5]].sum()
    assert hits >= 0.9 * 5 * len(asked) and made < share * len(v) * len(asked)


def test_a_hot_bucket_is_dealt_to_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 16)
    r = np.random.default_rng(1)
    rows = [(i, (np.eye(8)[0] + 1e-3 * r.standard_normal(8)).tolist()) for i in range(200)] + [(200 + i, r.standard_normal(8).tolist()) for i in range(100)]
    t = table(spark, rows)
    got = ranked(ann.nearest(t, t.where("vec_id % 50 = 0"), chance=1.0))
    expected = brute(rows, [x for x in rows if x[0] % 50 == 0], 5, cosine)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in expected.items()}


def test_many_blocks_of_products(spark, monkeypatch):
    for name, size in (("ROWS", 32), ("STRIPE", 2), ("QUERIES", 3)):
        monkeypatch.setattr(topk, name, size)
    r = np.random.default_rng(2)
    rows = [(i, (r.integers(-2, 3, 12) / 4).tolist()) for i in range(400)]  # many ties
    t = table(spark, rows)
    expected = brute([(i, [256 * x for x in v]) for i, v in rows], [x for x in rows if x[0] % 20 == 0], 5, lambda a, b: int(a @ b))
    assert ranked(topk.top_products(t, t.where("vec_id % 20 = 0"))) == expected


def test_sorted_block_drops_no_winner():
    r = np.random.default_rng(3)
    for _ in range(200):
        rows = r.integers(-300, 300, (r.integers(1, 200), r.integers(1, 9)))
        block = topk.SortedBlock(np.arange(len(rows)), rows)
        q = r.integers(-300, 300, rows.shape[1])
        own, k = int(r.integers(-1, len(rows))), 5
        all_scores = sorted(((int(s), -i) for i, s in enumerate(rows @ q) if i != own), reverse=True)
        for least in (None, all_scores[min(k, len(all_scores)) - 1][0] if all_scores else None):
            ids, scores = block.best(q, own, k, least)
            assert sorted(((int(s), -int(i)) for i, s in zip(ids, scores)), reverse=True)[:k] == all_scores[:k]


def test_best_keeps_the_smaller_ids():
    best = Best(2, most=4)
    for i in range(10, 0, -1):
        best.add(np.array([7]), np.array([i]), np.array([1.0]))
    assert best.cut()[1].tolist() == [1, 2]
