"""Tokens, packing, languages, toxicity, licences."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chronoweave.llm import byte_bpe, langid, licenses, packing, toxicity

RANKS, WORDS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.ByteBpe(byte_bpe.read_ranks(RANKS), public_tokenizers.PATTERN, remembered=500)


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def hf():
    return Tokenizer.from_file(WORDS)


# Byte-level BPE ---------------------------------------------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_ids_equal_the_library(bpe, reference, text):
    ids = bpe.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text)
    assert bpe.decode(ids) == text.encode()


def test_every_token_is_reached(bpe):
    r = random.Random(0)
    for rank in r.sample(range(len(bpe.tokens)), 3000):
        text = bpe.tokens[rank].decode("latin-1").translate(bpe._table)
        assert bpe._model.encode(text) == [rank]


def expected_codes(rows, reference):
    out = Counter()
    for i, t in rows:
        ids = np.array(reference.encode_ordinary(t or ""), "<u4").tobytes()
        out[i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    return out


def test_coded_documents(odd, docs, reference):
    for table in (odd, docs):
        got = Counter(tuple(r) for r in byte_bpe.encode_documents(table, RANKS, public_tokenizers.PATTERN).collect())
        assert got == expected_codes([(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()], reference)


def test_gaps_in_ranks(tmp_path):
    (tmp_path / "r").write_bytes(base64.b64encode(b"a") + b" 0\n" + base64.b64encode(b"b") + b" 2\n")
    with pytest.raises(ValueError, match="gaps"):
        byte_bpe.read_ranks(str(tmp_path / "r"))


# Packing ----------------------------------------------------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" .,'st\n!?Ii̇İΣσé")), max_size=80))
def test_word_ids_equal_the_library(hf, text):
    assert packing.word_tokenizer(WORDS).ids(text).tolist() == hf.encode(text, add_special_tokens=False).ids


def test_special_strings_equal_the_library(hf):
    text = "a <|endoftext|> b<|startoftext|>"
    assert packing.word_tokenizer(WORDS).ids(text).tolist() == hf.encode(text, add_special_tokens=False).ids


def check_pieces(rows, texts, hf):
    ids = {}
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id, r.doc_tokens].append(r)
    expected = defaultdict(list)
    for i, t in texts:
        e = [*hf.encode(t or "", add_special_tokens=False).ids, 1]
        expected[i, len(e)].append(np.array(e, "<u4"))
    assert set(by_doc) == set(expected)
    for key, pieces in by_doc.items():
        assert sum(r.length for r in pieces) == key[1] * len(expected[key])
        ids = expected[key][0]
        for r in pieces:
            assert r.ids_crc32 in {zlib.crc32(e[r.start : r.start + r.length].tobytes()) for e in expected[key]}
        if len(expected[key]) == 1:  # each id in exactly one piece
            spans = sorted((r.start, r.start + r.length) for r in pieces)
            assert spans[0][0] == 0 and spans[-1][1] == len(ids) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    windows = defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append(r)
    padding = total = 0
    for w in windows.values():
        w.sort(key=lambda r: r.offset)
        at = 0
        for r in w:
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 2048 and len({r.tier for r in w}) == 1 and at <= w[0].tier
        padding += 0 if at & (at - 1) == 0 else 2048 - at
        total += at
    return padding, total


def test_packed_documents(odd, docs, hf):
    for table in (odd, docs):
        rows = packing.pack_documents(table, WORDS).collect()
        padding, total = check_pieces(rows, [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()], hf)
        assert padding <= 2048 * table.rdd.getNumPartitions()


def test_no_documents_to_pack(nothing):
    assert packing.pack_documents(nothing, WORDS).collect() == []


def test_packer_fills_windows_and_balances_steps():
    r = random.Random(6)
    packer, windows, put = packing.Packer(), [], 0
    for i in range(3000):
        n = r.choice([1, 5, 60, 64, 65, 130, 700, 2047, 2048, 2049, 9000])
        put += n
        windows += packer.put(i, np.arange(n, dtype="<u4"))
    windows += packer.finish()
    sizes = [sum(len(p.ids) for p in pieces) for _, pieces, _ in windows]
    assert sum(sizes) == put
    assert sum(size != tier for size, (tier, _, _) in zip(sizes, windows)) <= 1
    assert {tier for tier, *_ in windows} > {256, 2048}
    steps = Counter()
    for size, (_, _, step) in zip(sizes, windows):
        steps[step] += size
    full = sorted(steps.values())[len(steps) // 20 :]
    assert max(full) - min(full) <= 2 * 2048


# Languages --------------------------------------------------------------------------------------------------------------


def test_languages_held_out(spark, docs):
    model = langid.fit(docs)
    rows = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and {r.held_out for r in rows} == {True, False}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows) and not any(r.rejected for r in rows)


def test_odd_languages(odd, docs):
    model = langid.fit(docs)
    got = {(r.doc_id, r.lang_pred, r.rejected) for r in langid.identify(odd, model).collect()}
    for i in (4, 5, 6, 11):
        assert (i, "und", True) in got
    assert {i for i, lang, _ in got if lang != "und"} == {1, 2, 3, 7, 8, 9, 10, 12, None, -3}
    kept = langid.keep_identified(odd, model)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {i for i, _, rejected in got if not rejected} >= {1, 2, 3, 7, 8, None, -3}


def test_nothing_to_learn(odd, nothing):
    for table in (nothing, odd.where("lang is null")):
        model = langid.fit(table)
        assert {r.lang_pred for r in langid.identify(odd, model).collect()} == {"und"}
    assert langid.identify(nothing, langid.fit(odd)).collect() == []


def test_other_alphabets_are_rejected(spark, docs):
    model = langid.fit(docs)
    far = spark.createDataFrame([(1, "漢字仮名交じり文 " * 40)], "doc_id long, text string")
    assert langid.identify(far, model).first().rejected


FOREIGN = [
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
    "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza.",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
    "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler.",
]


def test_unknown_languages_and_noise_are_rejected(docs):
    model, r = langid.fit(docs), random.Random(4)
    letters = [" ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(n)) for n in (60, 200, 1000)]
    coded = [base64.b64encode(r.randbytes(n)).decode() for n in (300, 3000)]
    rejected = {t[:20]: model.predict(t)[2] for t in [*FOREIGN, *letters, *coded, "Ωμέγα άλφα"]}
    assert all(rejected.values()), rejected
    assert model.predict("two words")[2] is False


def test_one_outlier_sets_no_floor_and_one_language_has_floors(spark, docs):
    english = docs.where("lang = 'en'").select("doc_id", "lang", "text")
    odd = spark.createDataFrame([(900_000, "en", "漢字仮名交じり文 " * 40), (900_002, "en", "漢字仮名交じり文 " * 41)], english.schema)
    for model in (langid.fit(english), langid.fit(docs.select("doc_id", "lang", "text").union(odd))):
        assert model.predict("xqjz vkwq " * 60)[2] and model.predict("Ωμέγα άλφα βήτα " * 40)[2]
        assert not any(model.predict(r.text)[2] for r in english.collect())


def test_kmeans_finds_separate_groups():
    x = np.repeat(np.eye(4), 10, axis=0) + 0.01 * np.random.default_rng(0).random((40, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert sorted((x @ langid.spherical_kmeans(x, 4).T).argmax(1)[::10].tolist()) == [0, 1, 2, 3]


# Toxicity ---------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def toxic_world(spark):
    """Invented texts in which toxic ones hold a few words that others lack."""
    r = random.Random(8)
    syllables = "ba de fi go lu ma ne pi ro su ta ve wi xo zu".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    rows, marks = [], []
    for i in range(1200):
        words = [word() for _ in range(r.choice([8, 30, 120]))]
        toxic = i % 6 == 0
        for _ in range(max(2, len(words) // 30) if toxic else 0):
            words.insert(r.randrange(len(words)), r.choice(["grumphole", "Snarkly!", "blechter", "vonkish"]))
        rows.append((i, " ".join(words)))
        marks.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), dict((i, t) for i, _, t in marks)


def test_toxic_texts_are_found(toxic_world):
    docs, labels, truth = toxic_world
    model = toxicity.fit(docs, labels)
    assert b"grumphole"[:6] in model.toxic and b"grumphole"[:6] not in model.ordinary
    rows = toxicity.score_documents(docs, model).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    kept = {r.doc_id for r in toxicity.keep_clean(docs, model).collect()}
    assert kept == {r.doc_id for r in rows if not r.predicted}


@pytest.mark.parametrize(
    "marks", [["zuq"], ["f*qk", "k1lj"], ["night watch"], ["alpha" * 3 + "grumphole"], [f"{a}{b}{c}x" for a in "qjkwyzh" for b in "aeiou" for c in ["brt", "ndk", "vvl", "mpt", "sks", "ghr", "ffd", "tzl", "rxw", "cqp", "ybn", "dhg"]]]
)
def test_all_kinds_of_toxic_words_are_found(marks):
    r = random.Random(9)
    word = lambda: "".join(r.choice("ba de fi go lu ma ne pi ro su ta ve wi xo".split()) for _ in range(r.randint(1, 4)))
    inner = "grumphole" in marks[0]

    def text(toxic):
        words = [r.choice(["night", "watch", word(), word(), word(), word()]) for _ in range(30)]
        words = [w for a, w in zip(["", *words], words) if a != "night" or w != "watch" and w != "night"]
        words = [w if a != "night" or w != "watch" else "ba" for a, w in zip(["", *words], words)]
        for _ in range((3, 8)[len(marks) > 9] if toxic else 0):
            words.insert(r.randrange(len(words)), word() + word() + "grumphole" if inner else r.choice(marks))
        return " ".join(words)

    by_class = [[toxicity.words_of(text(toxic)) for _ in range(3000 if len(marks) > 9 else 600)] for toxic in (False, True)]
    model = toxicity._with_dictionaries(by_class[1], by_class[0])
    model = toxicity._calibrated(model, [(toxic, model.gains(text(toxic)).tolist()) for toxic in (0, 1) for _ in range(200)])
    for toxic in (False, True):
        assert sum((model.score(text(toxic)) >= 0.5) == toxic for _ in range(200)) >= 190


def test_toxic_words_in_text_without_spaces():
    r = random.Random(10)
    run = lambda toxic: "".join(r.choice("的一是不了人我在有他这中大来上国") for _ in range(r.randint(30, 60))) + ("毒害" * toxic) + "".join(r.choice("的一是不了人我在有他这中大来上国") for _ in range(r.randint(30, 60)))
    by_class = [[toxicity.words_of(run(toxic)) for _ in range(300)] for toxic in (0, 1)]
    model = toxicity._with_dictionaries(by_class[1], by_class[0])
    model = toxicity._calibrated(model, [(toxic, model.gains(run(toxic)).tolist()) for toxic in (0, 1) for _ in range(100)])
    assert sum((model.score(run(i % 2)) >= 0.5) == i % 2 for i in range(200)) >= 190


def test_toxicity_equals_a_plain_comparison_of_two_compressors(toxic_world):
    docs, labels, _ = toxic_world
    model = toxicity.fit(docs, labels)
    assert model.toxic and model.weights
    plain, toxic = model.compressors()
    scores = {r.doc_id: r.score for r in toxicity.score_documents(docs, model).collect()}
    for doc_id, text in docs.limit(150).collect():
        gains = [max(0, len(plain.compress(w)) - len(toxic.compress(w))) for w in model.windows(text)]
        z = model.weights[0]
        for i, t in enumerate(model.thresholds):
            hits = [min(g, toxicity.MOST) for g in gains if g >= t]
            n, share = len(hits), max(1, len(gains))
            x = np.log1p(n), np.log1p(sum(hits)), min(1, 4 * n / share), min(1, sum(hits) / share)
            z += float(np.dot(model.weights[1 + 4 * i : 5 + 4 * i], x))
        assert abs(scores[doc_id] - 1 / (1 + np.exp(-z))) < 1e-9


def test_test_tables(docs, labels):
    model = toxicity.fit(docs, labels)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = [r for r in toxicity.score_documents(docs, model).collect() if r.doc_id in truth]
    clean = [r for r in rows if not truth[r.doc_id]]
    assert sum(r.predicted for r in clean) <= 0.03 * len(clean)


def test_odd_toxicity(toxic_world, odd, nothing):
    docs, labels, _ = toxic_world
    model = toxicity.fit(docs, labels)
    rows = toxicity.score_documents(odd, model).collect()
    empty = {r.score for r in rows if r.doc_id in (4, 5, 6)}
    assert len(rows) == odd.count() and len(empty) == 1 and not any(r.predicted for r in rows)
    assert toxicity.keep_clean(odd, model).columns == odd.columns
    assert toxicity.score_documents(nothing, model).collect() == []


def test_labels_of_one_class_or_none(toxic_world):
    docs, labels, _ = toxic_world
    for some, score in ((labels.where("toxic = 1"), 1.0), (labels.where("toxic = 0"), 0.0), (labels.where("false"), 0.0), (labels.selectExpr("doc_id", "cast(null as int) toxic"), 0.0)):
        assert {r.score for r in toxicity.score_documents(docs.limit(5), toxicity.fit(docs, some)).collect()} == {score}


def test_labels_without_texts_and_repeated_labels(toxic_world):
    docs, labels, truth = toxic_world
    more = labels.union(labels).union(labels.selectExpr("doc_id + 90000", "quality", "toxic"))
    rows = toxicity.score_documents(docs, toxicity.fit(docs, more)).collect()
    assert sum(r.predicted == truth[r.doc_id] for r in rows) >= 0.98 * len(rows)


# Licences ---------------------------------------------------------------------------------------------------------------


def test_licences_in_other_spellings(spark, odd, nothing):
    mit = licenses.KNOWN["MIT"]
    texts = [
        (1, mit), (2, "Copyright (c) 2021 Someone\n\n" + mit.upper().replace("\n", " \t\n")), (3, mit.replace(".", " ;")), (4, mit + " and more"),
        (5, "released under the MIT licence"), (6, "Released  under the\nM.I.T License"), (7, None), (8, ""), (9, licenses.KNOWN["ISC"]),
        (10, "Released under the MIT License.\n© 2020 X\nAll rights reserved."),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 license_id", "2 digest")
    got = {r.doc_id: r.license_id for r in licenses.scan_licenses(docs).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: "MIT", 4: None, 5: "MIT-notice", 6: None, 7: None, 8: None, 9: "ISC", 10: "MIT-notice"}
    assert licenses.scan_licenses(odd).count() == odd.count() and licenses.scan_licenses(nothing).count() == 0
    assert {r.digest is None for r in licenses.scan_licenses(docs).where("doc_id = 7").collect()} == {True}


def test_whole_licences_titles_and_copyright_statements(spark):
    mit, folder = licenses.KNOWN["MIT"], licenses.Path(licenses.__file__).parent / "license_texts"
    texts = [(p.stem, p.read_text(encoding="utf-8").replace("  ", " ")) for p in sorted(folder.glob("*.txt"))]
    texts += [("Apache-2.0", t.split("APPENDIX")[0]) for name, t in texts if name == "Apache-2.0"]
    for head in ("The MIT License (MIT)", "Copyright Jane Doe 2020", "Copyright by X\n  Copyright: 2020", "The MIT License\n\nCopyright 2020, Y\nAll rights reserved."):
        texts.append(("MIT", head + "\n\n" + mit))
    texts += [("ISC", "ISC License\n\n" + licenses.KNOWN["ISC"]), ("BSD-3-Clause", "BSD 3-Clause License\n" + licenses.KNOWN["BSD-3-Clause"])]
    texts += [(None, "Copyright law\n"), (None, "\n" * 5000 + "x"), (None, "A poem\n" + mit)]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.license_id for r in licenses.scan_licenses(docs).collect()} == {i: name for i, (name, _) in enumerate(texts)}


def test_own_licences(spark):
    own = spark.createDataFrame([("b", "Some terms"), ("a", "some TERMS!"), ("c", None), ("d", "...")], "license_id string, text string")
    docs = spark.createDataFrame([(1, "some terms"), (2, "...")], "doc_id long, text string")
    assert {r.doc_id: r.license_id for r in licenses.scan_licenses(docs, own).collect()} == {1: "a", 2: None}


def test_licence_sql(spark, data, docs):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    rows = Counter(con.execute(f"SELECT doc_id, digest, license_id FROM ({licenses.duckdb_sql()})").fetchall())
    assert rows == Counter(tuple(r) for r in licenses.scan_licenses(docs).collect())
