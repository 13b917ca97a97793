"""Edge cases of every operator, and brute force where SQL can't follow."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hunkflow.llm import exact_dedup, graph, html_text, license_scan, mixing, near_join, packing, quality_model, quality_rules, queries, sharding, substring_dedup
from tests.conftest import SMALL

#: Documents with clashing extra columns, nulls, blanks, a long text and repeats.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, score double, _sha string"
LONG = " ".join(f"w{i % 977}x{i % 89}" for i in range(30_000))
ROWS = [
    (1, "one two three four five six seven", "en", "a", 33, "s", 0.5, "x"),
    (2, None, None, None, None, None, None, None),
    (3, "", "en", "a", 0, "s", 0.5, "x"),
    (4, " \t\n", "en", None, 3, "s", 0.5, "x"),
    (5, LONG, "de", "b", 1, "s", 0.5, "x"),
    (6, LONG + " more", "de", "b", 1, "s", 0.5, "x"),
    (1, "one two three four five six seven", "en", "a", 33, "s", 0.5, "x"),
    (7, "one  two three four five six seven", "en", "a", 34, "s", 0.5, "x"),
    (None, "one two three four five six seven", "en", "a", 33, "s", 0.5, "x"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(same, name):
    same(queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_empty_tables(spark, none):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality_model.fit(none, labels)
    results = [
        sharding.assign_shards(none), quality_rules.judge(none), quality_rules.filter_documents(none), exact_dedup.dedup(none), exact_dedup.drop_copies(none), quality_model.classify(none, model),
        substring_dedup.find_spans(none), license_scan.scan(none), mixing.mix(none), mixing.repeat_documents(none), packing.pack_documents(none, packing.public_tokenizer()), html_text.extract(pages), near_join.join(none), near_join.keep_one(none),
    ]
    assert [r.count() for r in results] == [0] * len(results)


def test_sharding(spark, odd):
    rows = sharding.assign_shards(odd, 100).collect()
    assert len(rows) == len(ROWS)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert all(sum(r.n_bytes for r in b) <= 100 or len(b) == 1 for b in by.values())
    assert all(r.shard_rows == len(by[r.shard]) and r.depth == len(r.shard) for r in rows)
    assert not any(a != b and b.startswith(a) for a in by for b in by)
    # a key that holds all rows still splits
    hot = spark.range(400).selectExpr("7L AS doc_id", "repeat('x', 10) AS text")
    shards = sharding.assign_shards(hot, 500).collect()
    assert max(r.shard_bytes for r in shards) <= 500 and len(shards) == 400


def test_write_shards(spark, odd, tmp_path):
    sharding.write_shards(odd, str(tmp_path / "out"), 100)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert "_shard" in back.columns and sorted(map(str, back.select(*odd.columns).collect())) == sorted(map(str, odd.collect()))
    dealt = collections.Counter(r.shard for r in sharding.assign_shards(odd, 100).collect())
    assert collections.Counter(r._shard for r in back.collect()) == {f"b{s}": n for s, n in dealt.items()}
    sharding.write_shards(odd.withColumns({"depth": F.lit(1), "n_bytes": F.lit(2), "row": F.lit(3)}).drop("shard"), str(tmp_path / "clash"))
    assert spark.read.parquet(str(tmp_path / "clash")).count() == len(ROWS)


def test_quality_rules(odd):
    rows = quality_rules.judge(odd).collect()
    assert sorted((r.n_words, r.base_failed) for r in rows if r.n_words < 10) == [(0, True)] * 3 + [(7, True)] * 4
    kept = quality_rules.filter_documents(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} <= {5, 6}
    assert quality_rules.measure("# a\n# a\n\nb c a b c") == (9, 9, 2, 1, 6, 3, 0)


def test_repeated_words():
    for _ in range(200):
        words = [random.choice("abc") for _ in range(random.randrange(30))]
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
        assert quality_rules.measure(" ".join(words))[4] == len(covered)


def _limits(spark, shift):
    rows = [(i, "en", s, i % 10 + base, 480 + i % 40 + base) for i in range(1200) for s, base in (("plain", 0), ("code", shift))]
    measured = spark.createDataFrame(rows, "id long, lang string, source string, symbols long, word_length long").selectExpr("*", "0L AS dup_lines", "0L AS repeats", "0L AS capitals", "200L + id % 100 AS n_words", "10L AS n_lines", "1000L + id AS word_chars")
    return {r.source: r for r in quality_rules.thresholds(quality_rules.sketches(measured)).collect()}


def test_thresholds_follow_the_group(spark):
    limits, moved = _limits(spark, 300), _limits(spark, 100)
    assert 15 < limits["plain"].max_symbols < 30 and 310 < limits["code"].max_symbols < 345
    assert limits["plain"] == moved["plain"] and moved["code"].max_symbols < limits["code"].max_symbols - 150
    assert limits["plain"].max_word_length < 780 < limits["code"].max_word_length and moved["code"].min_word_length < limits["code"].min_word_length
    # nothing but the width of a few events where a group has none of what is counted
    assert 1000 * 5 / 1300 * 0.98 < limits["plain"].max_capitals < 1000 * 5 / 1300 * 1.02


def test_verdicts_move_with_the_group(spark):
    def docs(dense):
        rows = [(i, " ".join(f"w{j}x{i}" for j in range(120)) + " #" * (i % 3 + (40 if dense else 0)), "en", "a") for i in range(300)]
        return spark.createDataFrame([*rows, (999, " ".join(f"w{j}x7" for j in range(120)) + " #" * 40, "en", "a")], "doc_id long, text string, lang string, source string")

    verdict = lambda dense: {r.doc_id: r.kept for r in quality_rules.judge(docs(dense)).collect()}
    assert not verdict(False)[999] and verdict(True)[999]  # the same text, an outlier in one group and usual in the other


def test_cuckoo_index():
    index, keys = exact_dedup.CuckooIndex(4), [hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(3000)]
    for k in keys:
        index.insert(k, [1])
    assert index.resizes and all(index.probe(k) for k in keys)
    assert all(index.delete(k) for k in keys[::2]) and not index.delete(keys[0])
    assert [bool(index.probe(k)) for k in keys] == [bool(i % 2) for i in range(3000)] and index.n == 1500


def test_exact_dedup(odd):
    rows = exact_dedup.dedup(odd).collect()
    assert sum(r.kept for r in rows) == 4  # blanks, the short one, two long ones
    short = [r for r in rows if r.group_size == 4]
    assert {r.keep_id for r in short} == {7} and {r.keep_id for r in rows if r.group_size == 3} == {4}
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [4, 5, 6, 7]


def test_exact_dedup_repeated_row_stays_once(spark):
    df = spark.createDataFrame([(1, "a b", "x")] * 3 + [(2, "ab", "y")], "doc_id long, text string, more string")
    assert [r.kept for r in exact_dedup.dedup(df).collect()].count(True) == 1
    assert [tuple(r) for r in exact_dedup.drop_copies(df).collect()] == [(1, "a b", "x")]


def test_index_deletions(spark):
    schema = exact_dedup.ENTRY
    live = spark.createDataFrame([(bytearray(hashlib.sha256(b"a").digest()), 1, 1, 1, 2, 1), (bytearray(hashlib.sha256(b"b").digest()), 1, 2, 2, 1, 1)], schema)
    gone = spark.createDataFrame([(bytearray(hashlib.sha256(b).digest()), 1, 9, 9, 1, 1) for b in (b"a", b"b", b"c")], schema)
    assert [(r.doc_id, r.n) for r in exact_dedup.apply_deletions(live, gone, 2).collect()] == [(1, 1)]


def test_quality_model_held_out(spark):
    rows = quality_model.op4_quality_model(spark, SMALL.replace("0.001", "0.01")).join(spark.read.parquet(SMALL.replace("0.001", "0.01") + "/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_scores_are_sums_of_looked_up_bins(spark):
    """Scores of the small documents, added up cell by cell."""
    import bisect
    import math

    docs, labels = (spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("documents", "labels"))
    model = quality_model.fit(docs, labels)
    assert len(model.pairs) == quality_model.PAIRS and any(t.any() for t in model.pair_tables)
    scores = {r.doc_id: r.score for r in quality_model.classify(docs, model).collect()}
    for row in docs.collect():
        x = quality_model.features(row.text)
        z = model.base + sum(t[bisect.bisect_right(e.tolist(), v)] for e, t, v in zip(model.edges, model.tables, x, strict=True))
        at = [bisect.bisect_right(e.tolist(), v) for e, v in zip(model.pair_edges, x, strict=True)]
        z += sum(t[at[i], at[j]] for (i, j), t in zip(model.pairs, model.pair_tables, strict=True))
        assert abs(scores[row.doc_id] - 1 / (1 + math.exp(-max(-35, min(35, z))))) < 1e-9
    # rows that repeat an id don't change the sample's size or depend on their order
    twice = docs.unionAll(docs.select("doc_id", F.lit("zz zz zz").alias("text"), "lang", "source", "n_chars"))
    one, other = (quality_model.fit(d, labels).base for d in (twice, twice.orderBy(F.desc("text"))))
    assert one == other == model.base


def test_quality_model_edges(odd):
    model = quality_model.train(np.zeros((0, len(quality_model.FEATURES))), np.zeros(0))
    rows = quality_model.classify(odd, model).collect()
    assert len(rows) == len(ROWS) and {r.score for r in rows} == {0.5} and {r.predicted for r in rows} == {1}
    x = np.random.default_rng(1).random((600, len(quality_model.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # only a pair of features tells
    assert np.mean((quality_model.train(x, y).score(x) > 0.5) == y) > 0.9


def test_substring_dedup(odd):
    rows = substring_dedup.find_spans(odd).collect()
    assert {r.doc_id: r.n_removed for r in rows if r.doc_id in (5, 6)} == {5: 0, 6: 30_000}
    assert sum(r.n_removed for r in rows) == 30_000
    assert [r.kept_sha256 for r in rows if r.doc_id == 6] == [hashlib.sha256(b"more").hexdigest()]
    hit, r, p = np.array([0, 1, 1, 0, 1, 1, 1], bool), np.array([0, 9, 9, 0, 9, -8, -8]), np.array([0, 4, 5, 0, 2, 3, 4])
    assert substring_dedup.factors(hit, r, p, 3) == [(1, 5, 9, 4), (4, 7, 9, 2), (5, 9, -8, 3)]


def brute_removed(rows):
    """Removed words per row by comparing all phrases as words."""
    first = {}
    for id_, text in rows:
        words, key = (text or "").split(), substring_dedup.NO_ID if id_ is None else id_
        for i in range(len(words) - 12):
            phrase = tuple(words[i : i + 13])
            first[phrase] = min(first.get(phrase, key), key)
    out = []
    for id_, text in rows:
        words, key = (text or "").split(), substring_dedup.NO_ID if id_ is None else id_
        gone = {i + k for i in range(len(words) - 12) if first[tuple(words[i : i + 13])] < key for k in range(13)}
        out.append((id_, len(words), len(gone), hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def test_substring_dedup_against_brute_force(spark):
    """Copies, passages of all lengths, texts of few words, shared and missing ids."""
    rng, rows = random.Random(12), []
    passages = [[f"p{rng.randrange(900)}" for _ in range(n)] for n in (12, 13, 14, 20, 40, 90, 200)]
    for i in range(150):
        words = []
        for _ in range(rng.randrange(1, 5)):
            words += [f"w{rng.randrange(5 if i % 7 == 0 else 3000)}" for _ in range(rng.randrange(60))]
            start = rng.randrange(8)
            words += rng.choice(passages)[start if rng.random() < 0.5 else 0 :]
        if rows and i % 9 == 0:  # a copy with one word changed
            words = rng.choice(rows)[1].split()
            words[rng.randrange(len(words))] = "edit"
        rows.append((rng.choice([None, -5, 3]) if i % 20 == 19 else 1000 - i, " ".join(words)))
    rows += [(None, None), (2, ""), (-7, rows[3][1]), rows[5], rows[5]]
    got = substring_dedup.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == brute_removed(rows)
    # every factor is one contiguous piece of one earlier document
    texts = collections.defaultdict(list)
    for id_, text in rows:
        texts[substring_dedup.NO_ID if id_ is None else id_].append((text or "").split())
    n = 0
    for r in got:
        own = [w for w in texts[substring_dedup.NO_ID if r.doc_id is None else r.doc_id] if len(w) == r.n_words]
        for f in r.spans:
            n += 1
            length = f.end - f.start
            assert f.ref_id < (substring_dedup.NO_ID if r.doc_id is None else r.doc_id) and length >= 13
            if len(texts[f.ref_id]) == 1:
                assert any(o[f.start : f.end] == texts[f.ref_id][0][f.ref_start : f.ref_start + length] for o in own)
    assert n > 100


def test_anchors_and_chunks_depend_on_their_words_alone():
    words = np.random.default_rng(2).integers(0, 1 << 60, 40).astype(np.uint64)[np.random.default_rng(3).integers(0, 40, 600)]
    both = substring_dedup.sums(words)
    found = substring_dedup.anchors(both[0])
    assert len(found) == 588
    assert all(found[i] == substring_dedup.anchors(substring_dedup.sums(words[i : i + 13])[0])[0] for i in range(588))
    inner = substring_dedup.chunks(substring_dedup.sums(words[50:500]))
    outer = set(zip(*(c.tolist() for c in substring_dedup.chunks(both)), strict=True))
    assert len(inner[0]) > 5 and {(a + 50, b + 50, k1, k2) for a, b, k1, k2 in zip(*(c.tolist() for c in inner), strict=True)} <= outer


def test_license_scan(spark, odd):
    text = "x Released under the MIT\nLicense. CC-BY, CC BY; all rights reserved"
    row = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.n_base, row.first_word, row.last_word, row.base_labels, row.labels, row.score) == (3, 6, 10, "cc-by,reserved", "cc-by,mit,reserved", 1.0)
    assert all(r.labels == "" and r.score == 0 for r in license_scan.scan(odd).collect())


def word_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


def test_license_spans_are_verified(spark):
    """Texts with edited templates, against the edit distance of words at every place."""
    rng, texts = random.Random(8), {1: "under the mit zzz the mit license", 2: "licensed under cc by sa 4 0 or licensed under cc by nd 4 0", 3: "under the mit license under the mit license", 4: "a\x00under\x00THE mit LICENSE"}
    for i, (_, text) in enumerate(license_scan.TEMPLATES * 4):
        words = license_scan._template_words(text)
        for _ in range(rng.randrange(0, 1 + len(words) // 8)):
            at = rng.randrange(len(words))
            words[at : at + rng.randrange(2)] = rng.choice([[], ["zq"], ["zq", "zr"]])
        texts[10 + i] = " ".join([f"p{i}"] * rng.randrange(9) + words + ["x"] * rng.randrange(3))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r.id, r.template): r.edits for r in license_scan.spans(docs).collect()}
    for k, text in texts.items():
        words = license_scan._template_words(text)
        for n, (_, template) in enumerate(license_scan.TEMPLATES):
            wanted = license_scan._template_words(template)
            least = min(word_edits(words[a:b], wanted) for a in range(len(words)) for b in range(max(a, a + len(wanted) - 4), min(len(words), a + len(wanted) + 4) + 1)) if len(words) + 4 >= len(wanted) else 99
            # hits of three words see a little less than single words do
            assert ((k, n) in got) <= (10 * least <= len(wanted)) and ((k, n) in got) >= (20 * least <= len(wanted)), (k, n, least)
    assert {n for k, n in got if k == 1} == set() and {license_scan.TEMPLATES[n][0] for k, n in got if k in (2, 3, 4)} == {"cc-by-sa", "mit"}


def test_mixing(spark):
    rows = [(i, "w " * (5 + i % 7), "big" if i % 10 else ("small" if i % 20 else None)) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(df, 3.0).collect()
    tokens, budget = collections.Counter(), collections.Counter()
    for _, t, s in rows:
        tokens[s] += len(t.split())
    for r in mixed:
        budget[r.source] += r.n_tokens
    ratio = {s: budget[s] / tokens[s] for s in tokens}
    assert ratio["big"] == 1 and all(2.9 < ratio[s] <= 3.0 for s in ("small", None))
    assert {r.doc_id for r in mixed} == set(range(4000))  # no document is lost
    assert len(set((r.doc_id, r.epoch) for r in mixed)) == len(mixed)
    copies = collections.Counter(r.doc_id for r in mixing.repeat_documents(df, 3.0).collect())
    assert copies == collections.Counter(r.doc_id for r in mixed)


def test_mixing_entropy(spark):
    rng = np.random.default_rng(4)
    for sizes in ([900, 90, 10], np.exp(rng.normal(9, 3, 3000)).astype(int) + 1):
        sources = spark.createDataFrame([(str(i), int(t)) for i, t in enumerate(sizes)], "k string, t long")
        for target in (0.6, 0.9, 1.0):
            a = mixing.exponent(sources, target_entropy=target).first().a
            w = np.array(sizes, float) ** a
            w /= w.sum()
            assert abs(-(w * np.log(w)).sum() / np.log(len(w)) - target) < 1e-3
    assert mixing.exponent(sources.where("t < 0"), target_entropy=0.5).count() == mixing.exponent(sources.where("t < 0")).count() == 0


def test_mixing_edges(odd):
    """Nulls, a long text, names that clash, repeated rows and one id with many texts."""
    more = odd.withColumns({"k": F.lit(1), "_plan_cut": F.lit(2), "epoch": F.lit(3)})
    mixed = collections.Counter((r.doc_id, r.n_tokens) for r in mixing.mix(more, 3.0).collect())
    assert set(mixed) == {(r[0], len((r[1] or "").split())) for r in ROWS}
    back = mixing.repeat_documents(more, 3.0)
    assert back.columns == more.columns and collections.Counter((r.doc_id, len((r.text or "").split())) for r in back.collect()) == mixed
    same_id = odd.sparkSession.range(3000).selectExpr("7L AS doc_id", "concat('w ', id) AS text", "if(id < 2000, 'a', 'b') AS source")
    rows = mixing.mix(same_id, 2.0).collect()
    assert len({r.doc_key for r in rows}) == 3000 and 1900 < sum(r.source == "b" for r in rows) <= 2000


def check_sequences(rows):
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)


def test_packing_round_trip(spark, odd):
    """All rows, also those that repeat an id or have none, against the tokenizer."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.public_tokenizer())
    rows = packing.pack_documents(odd, packing.public_tokenizer()).collect()
    check_sequences(rows)
    wanted = collections.Counter()
    for doc_id, text, *_ in ROWS:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for r in {(r.start, r.length) for r in rows if r.doc_id == doc_id and r.doc_tokens == len(ids)}:
            wanted[doc_id, len(ids), *r, zlib.crc32(ids[r[0] : sum(r)].tobytes())] += 0
        wanted[doc_id, "tokens"] += len(ids)
    for r in rows:
        assert (r.doc_id, r.doc_tokens, r.start, r.length, r.ids_crc32) in wanted
        wanted[r.doc_id, "tokens"] -= r.length
    assert not any(wanted.values())


def test_packing_one_id(spark):
    """An id that holds most rows is spread over the groups."""
    docs = spark.createDataFrame([(7, f"w{i} x") for i in range(900)] + [(i, "y") for i in range(100)], "doc_id long, text string")
    rows = packing.pack_documents(docs, packing.public_tokenizer(), group_docs=100).collect()
    check_sequences(rows)
    tokens = sum(len(t.split()) + 1 for _, t in [(7, f"w x") for _ in range(900)]) + 200
    assert len({r.sequence_id >> 32 for r in rows if r.doc_id == 7}) == 10 and sum(r.length for r in rows) >= tokens


def test_words_of_an_unknown_tokenizer(tmp_path):
    import json

    with open(packing.public_tokenizer(), encoding="utf-8") as file:
        setup = json.load(file)
    setup["normalizer"] = None  # capitals now matter
    path = tmp_path / "other.json"
    path.write_text(json.dumps(setup), encoding="utf-8")
    words = packing.Words(str(path))
    text = "It's an Other SETUP"
    assert np.frombuffer(words.encode(text), words.dtype).tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids != packing.Words(packing.public_tokenizer()).tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["It's 3.5€ ÀÉß ñandú", "a<|endoftext|>b 's x's", "é İ K ﬁ", "a b c\x1cd", "汉字 emoji 😀!", "don't,won't... ###x %%"])
def test_word_ids(text):
    words = packing.Words(packing.public_tokenizer())
    expected = words.tokenizer.encode(text, add_special_tokens=False).ids
    for _ in range(2):
        assert np.frombuffer(words.encode(text), words.dtype).tolist() == expected


def test_pack():
    rng = random.Random(3)
    for _ in range(200):
        lengths = [rng.choice([1, 2, 100, 2047, 2048, 4096, rng.randrange(1, 6000)]) for _ in range(rng.randrange(50))]
        covered = [np.zeros(n, int) for n in lengths]
        for bin_ in packing.pack(lengths):
            assert 0 < sum(n for _, _, n in bin_) <= 2048
            for d, s, n in bin_:
                covered[d][s : s + n] += 1
        assert all((c == 1).all() for c in covered)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header class="site"><a href="/">Home</a></header>
<nav><ul><li><a href=a>News</a><li><a href=b>Shop</a></ul></nav><div class="ad">Buy now, only today, a lot of things for little money indeed.</div>
<article><h1>Title &amp; more</h1><p>First   paragraph with <b>bold</b> text,<br>and a break &copy; here.<p>Be.<script>var a = "</p>"; document.write("<p>no</p>")</script>
<!-- <p>hidden</p> --><div class="comments"><p>I liked this article so much that I had to write something.</div><p>Last &lt;one&gt;.</article>
<aside>Related things to read that are long enough to look like text.</aside><form><p>Your name</p></form><footer>&copy; site</footer></body></html>"""


def test_html(spark):
    tree = html_text.grow(*html_text.labelled_blocks())
    assert html_text.main_text(PAGE, tree) == "Title & more\n\nFirst paragraph with bold text, and a break © here.\n\nBe.\n\nLast <one>."
    rows = html_text.extract(spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "v", ""), (4, "w", "<p"), (5, "x", "<article><p>cut &am"), (1, "u", PAGE)], "page_id long, url string, html string")).collect()
    assert [(r.page_id, r.n_chars) for r in rows][1:5] == [(2, 0), (3, 0), (4, 0), (5, 7)] and rows[0] == rows[5]


LINE = " ".join(["word"] * 60)


@pytest.mark.parametrize(
    "page, text",
    [
        # nothing is named
        ("<div><a href=a>One</a></div><div><a href=b>Two</a></div><div><p>L a</p><p>L b</p></div><div><a href=c>Three</a></div>", "L a|L b"),
        ("<ul><li><a href=a>One</a><li><a href=b>Two</a></ul><div>Seven short words of an advert here</div><h1>Title</h1><p>L<p>Be.<p>L b<div>the site 2020</div>", "Title|L|Be.|L b"),
        # names that hold a word of articles or furniture and mean neither
        ('<div class="text-center"><a href=a>Home</a></div><div class="text-center"><a href=b>Shop</a></div><div><p>L</p><p>L b</p></div>', "L|L b"),
        ('<body class="has-sidebar"><main><h1>T</h1><section class="legal"><p>L</p><p>L b</p></section></main></body>', "T|L|L b"),
        # names on blocks themselves, hidden blocks and hidden parts of blocks
        ('<article><p>L</p><p class="advert">L c</p><p style="display: none">L d</p><p hidden>L e</p><p>L <span hidden>x <span>y</span> z</span>f</p></article>', "L|L f"),
        ('<article><p>L</p><table><tr><td class=ad>L<td>L b</table><p>L c</article>', "L|L b|L c"),
        ('<article><p>L</p><div class="userComments"><p>L a</p></div><div id=relatedPosts><a href=x>more</a></div><p>L b</p></article><aside>L</aside>', "L|L b"),
        ('<header><p>L</p></header><article><header><h1>T</h1></header><p>L</p></article><footer><p>L</p></footer>', "T|L"),
    ],
)
def test_html_blocks(page, text):
    tree = html_text.grow(*html_text.labelled_blocks())
    assert html_text.main_text(page.replace("L", LINE), tree) == text.replace("L", LINE).replace("|", "\n\n")


def test_html_tree_on_pages_it_has_not_seen():
    lines = html_text.PAGES.strip().split("\n")
    right = total = unnamed = 0
    for k in range(5):
        tree = html_text.grow(*html_text.labelled_blocks("\n".join(line for i, line in enumerate(lines) if i % 5 != k)))
        for line in lines[k::5]:
            found, labels = html_text.labelled_page(line)
            verdicts = [html_text.is_text(tree, r) == bool(y) for r, y in zip(html_text.describe(found), labels, strict=True)]
            right, total = right + sum(verdicts), total + len(verdicts)
            unnamed += sum(html_text.is_text(tree, r) == bool(y) for r, y in zip(html_text.describe([(*b[:3], 0) for b in found]), labels, strict=True))
    assert right > 0.9 * total and unnamed > 0.75 * total, (right, unnamed, total)


def test_html_words_and_links_decide(spark):
    """The shared pages, as they are and with names and telling elements taken away."""
    import html
    import re

    tree = html_text.grow(*html_text.labelled_blocks())
    for row in spark.read.parquet(f"{SMALL}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)</article>", row.html, re.S)[1]
        wanted = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?p>|</?h1>", article)]
        bare = re.sub(r"<(/?)(?:nav|article|footer|div)\b[^>]*>", r"<\1div>", row.html)
        assert html_text.main_text(row.html, tree) == html_text.main_text(bare, tree) == "\n\n".join(w for w in wanted if w)


def test_html_edges(spark):
    long_page = "<article>" + "<p>word <b>more</b></p>" * 20_000 + "</article>" + "<div>" * 20_000
    pages = spark.createDataFrame([(1, "u", long_page, "t", 3), (2, "u", "<div class=>&#0;</div><p", None, None)], "page_id long, url string, html string, text string, n_chars int")
    assert sorted(tuple(r)[:2] + (r.n_chars,) for r in html_text.extract(pages).collect()) == [(1, "u", 20_000 * 9 + 19_999 * 2), (2, "u", 0)]


def brute_groups(texts):
    sets = {}
    for k, t in texts.items():
        w = (t or "").encode().split()
        sets[k] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    first = {}
    for k in sorted(sets):
        first.setdefault(sets[k] or k, k)
    own = {k: first[sets[k] or k] for k in sets}
    reps = sorted(set(own.values()))
    root, links = {k: k for k in reps}, collections.Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(reps):
        for b in reps[i + 1 :]:
            if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (own[k], find(own[k]), links[own[k]]) for k in sets}


def near_texts(n):
    rng, texts = random.Random(5), {}
    for g in range(n // 10):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(30, 200))]
        for i in range(10):
            copy = list(words)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = f"v{rng.randrange(4000)}"
            texts[10 * g + i] = " ".join(copy)
    return texts | {n: None, n + 1: "", n + 2: "a b", n + 3: "a  b"}


@pytest.mark.parametrize("task", [4096, 40])
def test_near_join(spark, monkeypatch, task):
    monkeypatch.setattr(near_join, "TASK", task)
    monkeypatch.setattr(near_join, "BLOCK", task // 4)
    texts = near_texts(200)
    if task == 40:  # one group that must be cut
        words, rng = [f"w{i}" for i in range(120)], random.Random(6)
        for i in range(150):
            copy = list(words)
            copy[rng.randrange(120)] = f"x{i}"
            texts[1000 + i] = " ".join(copy[: rng.randrange(80, 121)])
    rows = near_join.join(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    expected = brute_groups(texts)
    wrong = [r for r in rows if (r.class_id, r.group_id, r.n_links) != expected[r.doc_id]]
    assert len(rows) == len(texts) and len(wrong) <= 0.02 * len(texts), wrong[:3]


def test_near_join_edges(odd):
    rows = near_join.join(odd).collect()
    assert sorted((r.doc_id, r.class_id, r.group_id, r.n_links) for r in rows if r.doc_id in (5, 6)) == [(5, 5, 5, 1), (6, 6, 5, 1)]
    assert {r.class_id for r in rows if r.doc_id in (1, 7)} == {1} and [r.class_id for r in rows if r.doc_id is None] == [None]
    kept = near_join.keep_one(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, 4, 5, None}


def test_near_join_tells_rows_of_one_id_apart(spark):
    x = [f"x{i}" for i in range(60)]
    near, y = " ".join([*x[:-1], "z"]), " ".join(f"y{i}" for i in range(60))
    rows = [(3, " ".join(x)), (7, near), (7, y), (9, y + " more"), (9, " ".join(f"u{i}" for i in range(60)))]
    for texts in (rows, rows[::-1]):
        docs = spark.createDataFrame(texts, "doc_id long, text string")
        got = sorted((r.doc_id, r.class_id, r.group_id, r.n_links) for r in near_join.join(docs).collect())
        assert got == [(3, 3, 3, 1), (7, 7, 3, 1), (7, 7, 7, 1), (9, 9, 7, 1), (9, 9, 9, 0)]
        assert sorted(map(tuple, near_join.keep_one(docs).collect())) == sorted([rows[0], rows[2], rows[4]])
    same_id = spark.createDataFrame([(4, " ".join(x)), (4, near)], "doc_id long, text string")
    assert near_join.keep_one(same_id).count() == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(50, 60), (60, 70), (70, 50)]
    got = {r.id: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {50: 50, 60: 50, 70: 50}


def test_pipeline_on_odd_tables(spark, odd, none):
    """Nulls, blanks, repeats and clashing names go through every stage, and so does nothing."""
    import corpus_pipeline

    for docs in (odd, none):
        columns = docs.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SMALL)
            assert docs.columns == columns
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
        assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}


def test_pipeline(spark):
    """Stage by stage against plain Python on the small documents."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {r.doc_id for r in quality_rules.judge(docs).where("kept").collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in kept}
    groups = collections.defaultdict(list)
    for k, t in texts.items():
        groups["".join(t.split(" ")).translate({c: None for c in range(9, 14)})].append((-len(t), k))
    texts = {k: texts[k] for g in groups.values() for k in [min(g)[1]]}
    near = brute_groups(texts)
    texts = {k: t for k, t in texts.items() if near[k][1] == k}
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in rows} == set(texts)
    total = sum(r.length for r in rows)
    packed = collections.defaultdict(int)
    for r in rows:
        packed[r.sequence_id] += r.length
    assert sum(packed.values()) == total and max(packed.values()) <= 2048
    tokens = {r.doc_id: r.doc_tokens for r in rows}
    read = collections.Counter()
    for r in rows:
        read[r.doc_id] += r.length
    assert all(read[k] % tokens[k] == 0 and 1 <= read[k] // tokens[k] <= 2 for k in tokens)


def test_license_scan_is_linear_in_repeats(spark):
    import time

    words = license_scan._template_words(license_scan.TEMPLATES[1][1])
    nearly = " ".join([*words[:10], "strange", *words[11:]])
    rng = random.Random(1)
    torn = " ".join(w for _ in range(20_000) for p in [rng.randrange(len(words) - 3)] for w in words[p : p + 3])
    texts = ["All rights reserved. " * 100_000, (nearly + " ") * 2000, torn, "under the MIT License " * 50_000]
    license_scan.scan(spark.createDataFrame([(0, "warm up")], "doc_id long, text string")).collect()
    began = time.time()
    rows = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).orderBy("doc_id").collect()
    assert time.time() - began < 60
    assert (rows[0].n_base, rows[0].first_word, rows[0].last_word, rows[0].labels) == (100_000, 0, 299_997, "reserved")
    assert rows[1].labels == "mit" and rows[1].score == round(1 - 1 / len(words), 6) and rows[2].score == 0 and (rows[3].labels, rows[3].score) == ("mit", 1)
    spans = license_scan.spans(spark.createDataFrame([(1, texts[1])], "doc_id long, text string")).collect()
    assert len(spans) == 2000 and {r.edits for r in spans} == {1}
