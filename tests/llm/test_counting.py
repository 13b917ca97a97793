"""Token counts and resampling: brute force and odd tables."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from hunkflow.llm import resampling, token_counts
from tests.conftest import SMALL
from tests.llm.test_operators import LONG, ROWS, SCHEMA


@pytest.fixture(scope="module")
def tokens():
    return token_counts.Tokens(token_counts.public_tokenizer())


def _library(tokens, text):
    return len(tokens.tokenizer.encode(text, add_special_tokens=False).ids)


def test_every_whole_token_is_one(tokens):
    assert len(tokens.whole) > 49_000
    assert all(len(e.ids) == 1 for e in tokens.tokenizer.encode_batch(sorted(tokens.whole), add_special_tokens=False))


def test_pieces_agree_on_all_claimed_characters(tokens):
    claimed = regex.compile(f"[{token_counts.AGREED}]")
    several = [c for c in map(chr, range(0x20000)) if claimed.match(c)]
    assert len(several) > 40_000
    for at in range(0, len(several), 500):
        text = "".join(f"a{c}!{c}1{c} {c}" for c in several[at : at + 500])
        assert [text[a:b] for _, (a, b) in tokens.tokenizer.pre_tokenizer.pre_tokenize_str(text)] == tokens.pieces.findall(text)


def test_counts_equal_the_library(tokens):
    parts = ["the", " whole", "  ", "\n\n", "'ll", "’s", "naïve", "12345", "$%&", "漢字", "🙂", "ՙ", "​", "\x1c", "\x85", "<|endoftext|>", "<|endoftext", "é", "é", "x" * 90]
    rng = random.Random(5)
    for _ in range(600):
        text = "".join(rng.choices(parts, k=rng.randrange(12)))
        assert tokens.count(text) == _library(tokens, text), text


def test_long_texts_are_cut_between_pieces(tokens, monkeypatch):
    text = " ".join(["some words, and   more\n"] * 200)
    whole = _library(tokens, text)
    monkeypatch.setattr(token_counts, "SLICE", 37)
    assert len(list(tokens._slices(text))) > 20 and "".join(tokens._slices(text)) == text and tokens.count(text) == whole
    assert tokens.count("x" * 500) == _library(tokens, "x" * 500)


def test_token_counts(spark, tokens):
    rows = token_counts.count_tokens(spark.createDataFrame(ROWS, SCHEMA).withColumn("text_", F.lit(1)), token_counts.public_tokenizer()).collect()
    want = sorted((r[0] is None, r[0] or 0, len((r[1] or "").encode()), _library(tokens, r[1] or "")) for r in ROWS)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in rows) and any(r.over_limit for r in rows)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = token_counts.op11_token_counts(spark, SMALL).collect()
    assert len(got) == len(docs) and all(r.n_tokens == _library(tokens, docs[r.doc_id]) for r in got)


def test_unknown_setup_goes_through_the_library(tmp_path):
    from hunkflow.llm.packing import public_tokenizer

    other = token_counts.Tokens(public_tokenizer())
    assert not other.known_setup and not other.whole and other.count("Some Text") == _library(other, "Some Text")


def _words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def _brute(docs, target, run, buckets, percent, least):
    def found(text):
        ws = _words(text)
        return [zlib.crc32(" ".join(ws[i : i + n]).encode()) % buckets for n in range(1, run + 1) for i in range(len(ws) - n + 1)]

    s, t = collections.Counter(b for _, x in docs for b in found(x)), collections.Counter(b for x in target for b in found(x))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for i, x in docs:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(map(gain, found(x)))
        rows.append((i, len(found(x)), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(_words(x))))
    fit = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2]))
    drawn = collections.Counter((*r[:4], n + 1) for n, r in enumerate(fit[: len(fit) * percent // 100]))
    rest = collections.Counter(r[:4] for r in rows) - collections.Counter(r[:4] for r in drawn.elements())
    return drawn + collections.Counter((*r, None) for r in rest.elements())


@pytest.mark.parametrize("run,percent,least", [(1, 10, 20), (2, 60, 2), (3, 100, 1)])
def test_resampling(spark, run, percent, least):
    rng = random.Random(run)
    docs = [(i, " ".join(rng.choices(["a", "Bb", "ß", "c3", "--", "d,e", "É"], k=rng.randrange(60)))) for i in range(200)]
    docs += [(3, "a a a a"), (3, "a a a a"), (None, "a b c"), (500, None), (501, ""), (502, LONG)]
    target = ["c3 c3 ß a", None, "", "Bb é"]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n_words": F.lit("x"), "rank": F.lit(0)})
    rows = resampling.resample(df, spark.createDataFrame([(x,) for x in target], "text string"), run, 97, percent, least).collect()
    assert collections.Counter(map(tuple, rows)) == _brute(docs, target, run, 97, percent, least)


def test_resampling_of_nothing(spark):
    none, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame(ROWS, SCHEMA)
    assert resampling.resample(none, some).count() == 0 and token_counts.count_tokens(none, token_counts.public_tokenizer()).count() == 0
    assert resampling.resample(some, none).count() == len(ROWS)
    with pytest.raises(ValueError):
        resampling.bucket_streams(some, buckets=1 << 17)


def test_streams_are_packed(spark):
    row = resampling.bucket_streams(spark.createDataFrame([(1, "a b a"), (2, None), (3, "b")], "doc_id long, text string").coalesce(1)).first()
    a, b = zlib.crc32(b"a") % 10_000, zlib.crc32(b"b") % 10_000
    assert row.doc_id == [1, 2, 3] and row.offset == [0, 3, 3] and np.frombuffer(row.stream, "<u2").tolist() == [a, b, a, b]
