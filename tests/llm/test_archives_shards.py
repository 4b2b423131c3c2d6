"""Archives and shards."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from chronoweave.llm import sharding, warc

PAGES = [
    (1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (3, None, "other"), (4, "http://a/4", None), (5, "http://a/5", ""),
    (6, "http://a/6", "WARC/1.1\r\nContent-Length: 5\r\n\r\nab\r\n\r\nWARC/1.1"), (7, "http://a/7", "ünïcode 漢字"), (8, "http://a\r\nX: 1", "<p>same</p>"),
    (9, "http://a/9", "x" * 300_000), (9, "http://a/9", "x" * 300_000),
]


def expected_headers(pages):
    largest = {}
    for page, _, html in pages:
        largest[html or ""] = max(largest.get(html or "", page), page)
    out = []
    for page, _, html in pages:
        raw = (html or "").encode()
        first = largest[html or ""]
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((page, len(raw), digest, *(("response", None) if page == first else ("revisit", first))))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 record_type", "2 payload", "3 refers_to")


def headers(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_round_trip(spark, pages, tmp_path):
    got = warc.deduplicated_archives(pages, str(tmp_path / "w"))
    assert headers(got) == expected_headers(PAGES)
    urls = {r.page_id: r.url for r in got.collect()}
    assert urls[3] == "urn:page:3" and urls[8] == "http://aX: 1"


def test_small_payloads_may_stay(spark, pages):
    got = {(r.page_id, r.record_type) for r in warc.deduplicated_archives(pages, min_bytes=12).collect()}
    assert {(1, "response"), (2, "response"), (4, "response"), (9, "response")} <= got and (5, "revisit") not in got


def test_real_pages(spark, data):
    table = spark.read.parquet(f"{data}/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in table.collect()]
    twice = table.union(table.selectExpr("page_id + 1000", "url", "html"))
    assert headers(warc.deduplicated_archives(twice)) == expected_headers(rows + [(p + 1000, u, h) for p, u, h in rows])


def test_no_pages(pages):
    assert warc.deduplicated_archives(pages.where("false")).count() == 0


def test_damage_is_found(spark, pages, tmp_path):
    path = tmp_path / "w"
    warc.deduplicated_archives(pages.where("page_id = 3"), str(path)).collect()
    import gzip

    file = next(p for p in path.glob("*.gz") if gzip.decompress(p.read_bytes()))
    for crc in path.glob(".*.crc"):
        crc.unlink()
    file.write_bytes(gzip.compress(gzip.decompress(file.read_bytes()).replace(b"other", b"Other")))
    with pytest.raises(Exception, match="does not match its digest"):
        warc.read_archives(spark, str(path)).collect()


def check_shards(rows, texts, shards):
    assert len(rows) == len(texts)
    slots, where = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r.shard].append(r.slot)
    for v in slots.values():
        assert sorted(v) == list(range(len(v)))
    facts = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == facts
    for r in rows:
        where[r.size, r.text_crc32].add(r.shard)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    assert all(len(s) == 1 for s in where.values())


def test_odd_documents_in_shards(odd):
    rows = sharding.shard_by_bytes(odd, 4).collect()
    check_shards(rows, [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()], 4)


def test_no_documents(nothing):
    assert sharding.shard_by_bytes(nothing).collect() == []


def test_balance(spark, data, docs):
    rows = sharding.shard_by_bytes(docs, 16).collect()
    check_shards(rows, [(r.doc_id, r.text) for r in docs.collect()], 16)
    load = Counter()
    for r in rows:
        load[r.shard] += r.size
    largest = max(len((r.text or "").encode()) for r in docs.collect())
    fair = sum(load.values()) / 16
    assert max(load.values()) <= max(1.02 * fair, largest + 1)


def test_a_group_larger_than_a_shard(spark):
    docs = spark.createDataFrame([(i, "h" * 1000) for i in range(300)] + [(1000 + i, f"{i:04d}" * 10) for i in range(600)], "doc_id long, text string")
    rows = sharding.shard_by_bytes(docs, 16).collect()
    check_shards(rows, [(r.doc_id, r.text) for r in docs.collect()], 16)
    assert len({r.shard for r in rows if r.size == 1001}) == 1


def test_shards_equal_plain_best_fit_of_all_groups(spark, odd, docs):
    """Loads are those of an item-by-item best fit of every group at the same capacity, however many groups have one size."""
    many = spark.createDataFrame([(i, f"{i % 700:04d}" * (1 + i % 3)) for i in range(3000)], "doc_id long, text string")
    for table, shards in ((many, 7), (docs.select("doc_id", "text"), 16), (odd.select("doc_id", "text"), 3)):
        rows = sharding.shard_by_bytes(table, shards).collect()
        texts = [(r.doc_id, r.text) for r in table.collect()]
        check_shards(rows, texts, shards)
        groups = Counter()
        for _, t in texts:
            groups[t] += len((t or "").encode()) + 1
        sizes = sorted(groups.values(), reverse=True)
        runs = sharding.balanced_runs(sorted(Counter(sizes).items(), reverse=True), shards)
        bins = [b for _, _, n, b in runs for _ in range(n)]
        assert sorted(s for s, _, n, _ in runs for _ in range(n)) == sorted(sizes)
        expected, load = Counter(), Counter()
        for s, b in zip(sizes, bins):
            expected[b] += s
        for r in rows:
            load[r.shard] += r.size
        assert load == expected


def test_repeated_rows_are_numbered_in_parts(spark):
    docs = spark.range(4000).selectExpr("cast(null as long) doc_id", "if(id % 3 = 0, null, 'the same') text")
    rows = sharding.shard_by_bytes(docs, 3).collect()
    check_shards(rows, [(r.doc_id, r.text) for r in docs.collect()], 3)


def plain_best_fit(sizes, capacity):
    bins, out = [], []
    for s in sizes:
        fits = [(room, i) for i, room in enumerate(bins) if room >= s]
        if s > capacity or not fits:
            bins.append(max(capacity, s))
            i = len(bins) - 1
        else:
            i = min(fits)[1]
        bins[i] -= s
        out.append(i)
    return out


def test_best_fit_equals_a_plain_search():
    r = random.Random(4)
    for _ in range(100):
        sizes = sorted((r.randint(1, 60) for _ in range(r.randint(0, 80))), reverse=True)
        assert sharding.best_fit_decreasing(sizes, 50) == plain_best_fit(sizes, 50)
        runs = sharding.best_fit_runs(sorted(Counter(sizes).items(), reverse=True), 50)
        assert [b for _, _, n, b in runs for _ in range(n)] == plain_best_fit(sizes, 50)
        assert sharding.best_fit_decreasing(sizes, 50, 1) is None or max(plain_best_fit(sizes, 50), default=0) == 0


def test_tree_stays_shallow_for_any_order():
    tree = sharding.RoomTree()
    for i in range(5000):
        tree.add(i, i)

    def depth(node):
        return 0 if node is None else 1 + max(depth(node[2]), depth(node[3]))

    assert depth(tree._root) < 60
    assert [tree.take_tightest(10)[0] for _ in range(3)] == [10, 11, 12] and tree.take_tightest(5000) is None
