"""Token counts of whole texts, with a short cut for pieces that are one token.

A byte-level tokenizer cuts a text into pieces by a pattern and merges the bytes
of each piece by itself. Most pieces of ordinary texts are strings of the
vocabulary that come out as exactly one token. Which strings do is proven
before any text is read, by merging each string of the vocabulary once
(``whole_tokens``); such pieces are then counted as they are, and only the rest
are merged, each different piece once per worker as long as it is remembered.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, modest_batches, table, worker_cache
from .packing import Recent, _byte_letters

LIMIT = 1024
SLICE = 1 << 20  # characters of a text that are cut into pieces at a time
CACHE = 100_000  # merged pieces that a worker remembers, of at most LONGEST characters each
LONGEST = 64
COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
# fixed values: the set-up and the pattern of byte-level pre-tokenizers
PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Blocks whose letters, digits and white space the library and ``regex`` agree
#: on, as a test shows; texts with others are cut by the library itself.
AGREED = r"\x00-՗Ḁ-⁯₠-₿←-⏿　-鿿가-힣\U0001f300-\U0001f64f"


class Tokens:
    """Counts tokens as the library does with this file: no begin, end or other
    added tokens, the strings of special tokens taken as such, nothing cut off.

    The short cut holds for byte-level BPE without a normalizer. With a file
    set up in another way each whole text goes through the library.
    """

    def __init__(self, path: str, whole: frozenset[str] | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            setup = json.load(file)
        model, added = setup["model"], setup["added_tokens"]
        plain = not any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added)
        self.known_setup = setup["normalizer"] is None and setup["pre_tokenizer"] == PRE_TOKENIZER and model["type"] == "BPE" and not model["dropout"] and not model["continuing_subword_prefix"] and not model["end_of_word_suffix"] and plain
        del setup, model
        self.letters = _byte_letters()
        self.pieces = regex.compile(PIECE)
        self.agreed = regex.compile(f"[{AGREED}]*")
        # a piece may start with the space before a letter: such a place is never inside one
        self.gap = regex.compile(r"(?<=\S)(?= \p{L})")
        self.special = regex.compile("|".join(sorted((regex.escape(t["content"]) for t in added), key=len, reverse=True)) or "(?!)")
        self.merged = Recent(CACHE)
        self.whole = self._prove() if whole is None else whole

    def _prove(self) -> frozenset[str]:
        """The strings of the vocabulary that are one piece and one token."""
        if not self.known_setup:
            return frozenset()
        byte = {c: b for b, c in enumerate(self.letters)}
        found = []
        for token, number in self.tokenizer.get_vocab(with_added_tokens=False).items():
            try:
                text = bytes(byte[c] for c in token).decode("utf-8")
            except (KeyError, UnicodeDecodeError):
                continue
            if self.pieces.findall(text) == [text] and [t.id for t in self.tokenizer.model.tokenize(token)] == [number]:
                found.append(text)
        return frozenset(found)

    def _merge(self, piece: str) -> int:
        n = self.merged.get(piece)
        if n is None:
            n = len(self.tokenizer.model.tokenize("".join(self.letters[b] for b in piece.encode())))
            if len(piece) <= LONGEST:
                self.merged.put(piece, n)
        return n

    def _slices(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > SLICE:
            found = self.gap.search(text, at + SLICE)
            end = found.start() if found else len(text)
            yield text[at:end]
            at = end
        yield text[at:] if at else text

    def _plain(self, text: str) -> int:
        n = 0
        for part in self._slices(text):
            if self.agreed.fullmatch(part):
                pieces = self.pieces.findall(part)
            else:
                pieces = [part[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(part)]
            for piece, times in Counter(pieces).items():
                n += times if piece in self.whole else times * self._merge(piece)
        return n

    def count(self, text: str) -> int:
        if not self.known_setup:
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if not self.special.search(text):
            return self._plain(text)
        between = self.special.split(text)
        return len(between) - 1 + sum(map(self._plain, between))


def whole_tokens(path: str) -> frozenset[str]:
    """What ``Tokens`` counts without merging: at most one string per entry of
    the vocabulary, so its size is that of the tokenizer's file."""
    return Tokens(path).whole


def _counter(path: str, whole: frozenset[str], limit: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = worker_cache(f"counts {path}", lambda: Tokens(path, whole))
        for batch in batches:
            n = [tokens.count(text.as_py()) for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=[f.split()[0] for f in COUNTS.split(", ")])

    return run


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, id_col: str = "doc_id") -> DataFrame:
    """One row per document: ``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens`` and
    ``over_limit`` (more than ``limit`` tokens).

    A null text is an empty one: no bytes, no tokens. Very long texts are cut
    into pieces slice by slice. Repeated rows and ids are counted each by
    themselves; an empty table gives no rows; other columns are ignored. One
    pass without a shuffle: what is broadcast has the size of the vocabulary.
    ``tokenizer_path`` must exist on every executor.
    """
    text = free_name(docs, "text_")
    whole = whole_tokens(tokenizer_path)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias(text))
    rows = rows.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text)
    return modest_batches(rows).mapInArrow(_counter(tokenizer_path, whole, limit), COUNTS)


def public_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op11_token_counts(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizer())
