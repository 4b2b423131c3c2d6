"""Near duplicates and the pipeline against plain versions."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from chronoweave.llm import neardup


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def plain_components(texts):
    """(doc_id, n, component) of rows by comparing every pair that has a shingle in common."""
    sets = [plain_set(t) for _, t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    held = defaultdict(list)
    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in held[x]).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                root[top(i)] = top(j)
        for x in s:
            held[x].append(i)
    low = {}
    for i, (doc, _) in enumerate(texts):
        if doc is not None:
            low[top(i)] = min(low.get(top(i), doc), doc)
    out = []
    for i, (doc, _) in enumerate(texts):
        comp = low.get(top(i)) if sets[i] else doc
        out.append((doc, len(sets[i]), comp, True if not sets[i] else doc is not None and doc == comp))
    return Counter(out)


def compare(df):
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect())
    assert got == plain_components([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])


def test_odd_documents(odd):
    compare(odd)


def test_test_tables(docs):
    compare(docs)


def test_no_documents(nothing, spark):
    assert neardup.near_duplicates(nothing).collect() == []
    compare(spark.createDataFrame([(1, None), (2, ""), (None, " ")], "doc_id long, text string"))


def spectrum(seed, copies, words=80):
    """Copies of a text with so many words changed that links, chains and classes apart occur."""
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(words)]
    rows = []
    for i in range(copies):
        text = list(base)
        for _ in range(r.randint(0, 6)):
            text[r.randrange(words)] = f"x{r.randrange(50)}"
        rows.append((i, " ".join(text)))
    return rows


def test_large_groups_with_classes_apart(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 700)
    monkeypatch.setattr(neardup, "CHUNK", 64)
    rows = spectrum(1, 150) + [(1000 + i, t) for i, t in spectrum(2, 60, 40)] + [(5000 + i, f"{i} " * 3 + "shared words that all of these have in common " * 2) for i in range(60)]
    compare(spark.createDataFrame(rows, "doc_id long, text string"))


def test_threshold_is_exact(spark):
    # 25 shingles; the last words cut off leave 20 of 25 (0.8), 19 (0.76), 18 (0.72).
    words = [f"t{i}" for i in range(29)]
    for cut, linked in ((24, True), (23, True), (22, False)):
        assert neardup._linked(25, cut - 4, cut - 4) is linked
    compare(spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:23])), (3, " ".join(words[:22]))], "doc_id long, text string"))


def test_repeated_ids_with_other_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    compare(spark.createDataFrame([(7, a), (7, b), (3, b + " tail"), (9, a + " tail"), (9, a + " tail")], "doc_id long, text string"))


def shuffled(spark):
    """Bytes written for shuffles so far."""
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    done = spark._jsc.sc().statusStore().executorList(False)
    return sum(done.apply(i).totalShuffleWrite() for i in range(done.size()))


def test_texts_are_not_shuffled(spark, monkeypatch):
    r = random.Random(4)
    rows = [(i, " ".join(f"{r.getrandbits(48):x}" for _ in range(1500))) for i in range(300)]
    rows += [(1000 + i, f"{rows[i][1]} and a tail") for i in range(10)]
    monkeypatch.setattr(neardup, "SALTS", 1)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with many rows
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        before = shuffled(spark)
        assert {r.doc_id for r in neardup.keep_first(docs).collect()} == set(range(300))
        assert shuffled(spark) - before < sum(len(t) for _, t in rows) / 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_picked_rows(spark, monkeypatch):
    numbers = [0, 7, 8, 32_767, 32_768, 40_000, (5 << 33) + 1, (1 << 62) + 32_767]
    rows = spark.createDataFrame([(n, str(n)) for n in [*numbers, 1, 9, 32_769, 5 << 33, 1 << 62]], "cw_row long, place string")
    wanted = spark.createDataFrame([(n,) for n in numbers + numbers[:3] + [2, 3 << 33]], "end long")
    for most in (8192, 4, 3, 0):
        monkeypatch.setattr(neardup, "BITMAPS", most)
        assert sorted(r.cw_row for r in neardup._picked(rows, wanted).collect()) == sorted(numbers)
    assert neardup._picked(rows, wanted.where("false")).collect() == []


def test_rows_with_too_many_numbers_for_bitmaps(spark, odd, monkeypatch):
    monkeypatch.setattr(neardup, "BITMAPS", 0)
    compare(odd)
    assert Counter(r.doc_id for r in neardup.keep_first(odd).collect()) == Counter([-3, 1, 4, 5, 6, 7, 9, None, 11, 12])


@pytest.mark.parametrize("share", [0.5, 0.75, 0.9])
def test_estimates(share):
    r = np.random.default_rng(int(100 * share))
    found = []
    for _ in range(40):
        common = r.integers(0, 1 << 63, int(400 * share), dtype=np.uint64)
        own = [r.integers(0, 1 << 63, (400 - len(common)) // 2, dtype=np.uint64) for _ in range(2)]
        sets = [np.unique(np.concatenate([common, o])) for o in own]
        u, v = (neardup.registers(s) for s in sets)
        assert (neardup.registers(np.union1d(*sets)) == np.maximum(u, v)).all()  # mergeable
        found.append(neardup.estimate(u, v, len(sets[0]), len(sets[1])))
    assert np.mean(found) == pytest.approx(share, abs=0.02) and np.std(found) < 0.05


def test_shingles_equal_plain_ones():
    r = random.Random(3)
    for _ in range(300):
        text = "".join(r.choice("ab \t\n\x0b\x0c\rAé\xa0\x85漢") for _ in range(r.randint(0, 60)))
        assert len(neardup.shingle_set(text)) == len(plain_set(text))
    assert (neardup.shingle_set("A b  c\td e F") == neardup.shingle_set("a B c d\ne f")).all()


def test_keep_first(odd):
    kept = neardup.keep_first(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([-3, 1, 4, 5, 6, 7, 9, None, 11, 12])


def test_keep_first_judges_rows(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(7, a), (7, b), (3, b + " tail"), (None, c), (None, c + " tail"), (None, c), (5, c), (None, None), (8, ""), (8, "")]
    rows += [(20, "one text that is here three times over")] * 3 + [(None, "null ids only, and two rows of them")] * 2
    for parts in (1, 3):
        got = neardup.keep_first(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
        expected = [(7, a), (3, b + " tail"), (5, c), (None, None), (8, ""), (8, ""), (20, rows[10][1]), (None, rows[-1][1])]
        assert Counter((r.doc_id, r.text) for r in got) == Counter(expected)


def test_stages(spark, data):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "language", "near_duplicates", "packing"]
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == columns
        n = out.count()
        assert n <= before and (name != "language" or n == before)
        docs, before = spark.createDataFrame(out.collect(), out.schema), n
    groups = plain_components([(r.doc_id, r.text) for r in docs.collect()])
    assert all(doc == comp for doc, _, comp, _ in groups)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}


def test_run(spark, data):
    assert corpus_pipeline.run(spark, data).select("doc_id").distinct().count() <= 200
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_take_empty_tables(spark, data, docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), data).count() == 0
