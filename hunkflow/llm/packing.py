"""Packing documents into fixed-length token sequences.

Where a document is read, it is cut into full sequences and a rest shorter than
one; full sequences are done, and only their numbers travel on. The rests are
dealt at random (by a hash of id and row) into groups of bounded expected size,
and so of bounded bytes, and each group is packed by itself: first-fit
decreasing, where a tournament tree over the bins' free space finds the first
bin that fits in logarithmic time. What first-fit leaves open is then closed by
cutting pieces of the emptiest bins, so a group ends with one open bin at most,
and that is dealt into sequences of power-of-two lengths, which need no padding.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, modest_batches, partitions, table, worker_cache

LENGTH = 2048
END_ID = 1
GROUP_DOCS = 1024  # expected documents of a group
CACHE = 150_000  # words in a generation of what a worker remembers
SLICE = 256  # documents tokenised together
PART_DOCS = 50_000  # rests of documents that one partition should receive, at most 4 or 8 KB each
PARTS = "grp long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
# fixed values: the tokenizer settings that the short cuts below know
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
#: What such a tokenizer cuts a lower-cased text into, for texts of these
#: characters only: ASCII other than control characters, and Latin-1 letters.
_SIMPLE = re.compile(r"[ \t\n\x0b\x0c\r!-~À-ÖØ-öø-ÿ]*")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")


def _byte_letters() -> list[str]:
    """The printable character by which byte-level vocabularies write each
    byte: itself where Latin-1 prints it, else one from U+0100 on."""
    printed = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in printed else next(rest)) for b in range(256)]


class Recent:
    """A bounded memory: when the new generation is full it becomes the old
    one, and what is asked for again moves on to the next."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def get(self, key):
        found = self.new.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[key] = value


class Words:
    """Ids of texts from remembered ids of their pieces, per worker process.

    The tokenizer lower-cases a text and cuts it into pieces that it encodes
    each by itself. Texts of common characters are cut here in the same way,
    and a new piece goes to the tokenizer's model, spelled byte by byte. In
    other texts (or with a special token's string) the unit is what stands
    between ASCII white space, and the whole tokenizer encodes a new one.

    Both hold for ``NORMALIZER`` and ``PRE_TOKENIZER`` only: with a tokenizer
    that is set up in another way, whole texts are encoded as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            setup = json.load(file)
        self.known_setup = setup["normalizer"] == NORMALIZER and setup["pre_tokenizer"] == PRE_TOKENIZER and setup["model"]["type"] == "BPE" and all(t["content"].startswith("<|") for t in setup["added_tokens"])
        del setup
        self.dtype = np.dtype("<u2" if max(self.tokenizer.get_vocab().values()) < 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        letters = _byte_letters()
        self.spell = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}
        self.pieces, self.words = Recent(CACHE), Recent(CACHE // 4)

    def _bytes(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def _piece(self, piece: str) -> bytes:
        return self._bytes([t.id for t in self.tokenizer.model.tokenize(piece if piece.isascii() else piece.translate(self.spell))])

    def _word(self, word: bytes) -> bytes:
        return self._bytes(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids)

    def encode(self, text: str | None) -> bytes:
        text = text or ""
        if not self.known_setup:
            return self._bytes(self.tokenizer.encode(text.encode("utf-8", "replace").decode(), add_special_tokens=False).ids)
        if _SIMPLE.fullmatch(text) and "<|" not in text:
            units, known, learn = _PIECES.findall(text.lower()), self.pieces, self._piece
        else:
            units, known, learn = text.encode("utf-8", "replace").split(), self.words, self._word
        ids = list(map(known.new.get, units))
        if None in ids:
            at = -1
            for _ in range(ids.count(None)):
                at = ids.index(None, at + 1)
                found = known.get(units[at])
                if found is None:
                    found = learn(units[at])
                    known.put(units[at], found)
                ids[at] = found
        return b"".join(ids)


def _cut(ids: bytes, dtype: np.dtype, capacity: int) -> Iterator[tuple[int, int, int | None, bytes | None]]:
    """(start, length, CRC, None) of the full sequences at the beginning of a
    document, then (start, length, None, ids) of the rest."""
    n = len(ids) // dtype.itemsize
    full = n - n % capacity
    for at in range(0, full, capacity):
        yield at, capacity, _crc(np.frombuffer(ids, dtype, capacity, at * dtype.itemsize)), None
    if n > full:
        yield full, n - full, None, ids[full * dtype.itemsize :]


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _tokeniser(path: str, capacity: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_cache(f"tokens {path}", lambda: Words(path))
        end = words._bytes([END_ID])
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                rows = []
                for grp, doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True):
                    ids = words.encode(text.as_py()) + end
                    n = len(ids) // words.dtype.itemsize
                    rows += [(grp, doc_id, start, length, crc, n, rest) for start, length, crc, rest in _cut(ids, words.dtype, capacity)]
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:-1]), pa.array(columns[-1], pa.binary())], names=[f.split()[0] for f in PARTS.split(", ")])

    return run


class Tournament:
    """Free space of bins 0, 1, ... in a complete binary tree of maxima."""

    def __init__(self, bins: int, capacity: int):
        self.size = 1 << max(bins - 1, 0).bit_length()
        self.tree = [capacity] * (2 * self.size)

    def first(self, need: int) -> int:
        """The first bin with that much space; there always is one."""
        tree, at = self.tree, 1
        while at < self.size:
            at *= 2
            if tree[at] < need:
                at += 1
        return at - self.size

    def take(self, bin_: int, amount: int) -> None:
        tree, at = self.tree, bin_ + self.size
        tree[at] -= amount
        at //= 2
        while at:
            tree[at] = max(tree[2 * at], tree[2 * at + 1])
            at //= 2


def pack(lengths: list[int], capacity: int = LENGTH) -> list[list[tuple[int, int, int]]]:
    """Sequences for documents of these lengths: lists of (document, start,
    length). Deterministic; each token of each document is in one piece."""
    full, items = [], []
    for d, n in enumerate(lengths):
        cut = n - n % capacity
        full += [[(d, s, capacity)] for s in range(0, cut, capacity)]
        if n > cut:
            items.append((n - cut, d, cut))
    items.sort(key=lambda x: (-x[0], x[1]))
    tree, bins = Tournament(len(items), capacity), []
    for n, d, s in items:
        b = tree.first(n)
        tree.take(b, n)
        if b == len(bins):
            bins.append([])
        bins[b].append((d, s, n))
    return full + _close(bins, capacity)


def _close(bins: list[list[tuple[int, int, int]]], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Fill the gaps of the fullest bins from the emptiest ones by cutting."""
    used = [sum(p[2] for p in b) for b in bins]
    order = sorted((b for b in range(len(bins)) if used[b] < capacity and used[b] & (used[b] - 1)), key=lambda b: (-used[b], b))
    lo, hi = 0, len(order) - 1
    while lo < hi:
        to, giver = order[lo], order[hi]
        d, s, n = bins[giver].pop()
        m = min(n, capacity - used[to])
        bins[to].append((d, s + n - m, m))
        used[to] += m
        used[giver] -= m
        if n > m:
            bins[giver].append((d, s, n - m))
        if used[to] == capacity:
            lo += 1
        if not used[giver]:
            hi -= 1
    out = [b for i, b in enumerate(bins) if b and (lo > hi or not order or i != order[lo])]
    if order and lo <= hi:
        out += _binary(bins[order[lo]], used[order[lo]])
    return out


def _binary(pieces: list[tuple[int, int, int]], total: int) -> list[list[tuple[int, int, int]]]:
    out, pieces = [], pieces[::-1]
    while total:
        room = 1 << total.bit_length() - 1
        total -= room
        out.append([])
        while room:
            d, s, n = pieces.pop()
            m = min(n, room)
            out[-1].append((d, s, m))
            room -= m
            if n > m:
                pieces.append((d, s + m, n - m))
    return out


def _pack_group(dtype: str, capacity: int) -> Callable:
    def run(group: pa.Table) -> pa.Table:
        whole, rests = [], []
        for row in zip(*(group.column(f.split()[0]).to_pylist() for f in PARTS.split(", ")), strict=True):
            (whole if row[-1] is None else rests).append(row)
        by_doc = lambda r: (r[1] is None, r[1] or 0, r[2], r[-1] or b"")
        rests.sort(key=by_doc)
        ids = [np.frombuffer(r[-1], dtype) for r in rests]
        base, rows, q = group.column("grp")[0].as_py() << 32, [], 0
        for pieces in pack([len(x) for x in ids], capacity):
            offset = 0
            for d, s, n in pieces:
                _, doc_id, start, _, _, doc_tokens, _ = rests[d]
                rows.append((doc_id, start + s, n, _crc(ids[d][s : s + n]), doc_tokens, base + q, offset))
                offset += n
            q += 1
        for _, doc_id, start, length, crc, doc_tokens, _ in sorted(whole, key=by_doc):
            rows.append((doc_id, start, length, crc, doc_tokens, base + q, 0))
            q += 1
        return pa.table([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=[f.split()[0] for f in PIECES.split(", ")])

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = LENGTH, group_docs: int = GROUP_DOCS, id_col: str = "doc_id") -> DataFrame:
    """One row per piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``,
    ``doc_tokens``, ``sequence_id``, ``offset``.

    A null or empty text is one token, the end id. Repeated rows are packed
    each by itself, and an id may hold any number of rows: groups are dealt by
    row. A document longer than a sequence is cut. An empty table gives no
    rows; other columns are ignored. ``docs`` should be a written table, so
    that a task which is run again numbers its rows as before.
    ``tokenizer_path`` must exist on every executor.
    """
    modest_batches(docs)
    n = docs.count()
    groups = max(1, -(-n // group_docs))
    grp = F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.monotonically_increasing_id()), F.lit(groups))
    rows = docs.select(grp.alias("grp"), F.col(id_col).cast("long").alias("doc_id"), "text")
    parts = rows.mapInArrow(frugal(_tokeniser(tokenizer_path, capacity)), PARTS)
    dealt = parts.repartition(partitions(docs.sparkSession, n, PART_DOCS), "grp")
    return dealt.groupBy("grp").applyInArrow(_pack_group(Words(tokenizer_path).dtype.str, capacity), PIECES)


def public_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op8_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizer())
