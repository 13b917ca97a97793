"""N-gram Jaccard self-join by MinHash banding.

Documents with the same set of word n-grams are one class; one document
stands for it. A class has a number of its own, so rows that share an id but
not their text are told apart. Classes meet in band buckets: ``BANDS`` and
``ROWS`` are the fewest hashes that find a pair at the similarity threshold
with the target recall.

The hub of a bucket is its smallest class. As a hub has one bucket per band,
two classes share a bucket of a band if and only if they have the same hub
there. So a class travels to each of its different hubs, mostly one or a few,
instead of its many buckets, and all that share a bucket meet. A pair counts at
the hub of the first band that it shares, hence once, and only if its full
n-gram sets are similar enough. Weak links don't chain groups together: a
class is compared with those of its own buckets only.

The group of a hub that is too large for one task, in classes or in n-grams,
is cut into blocks by the sizes of the sets: sets whose sizes differ by more
than the threshold allows can't be similar, so a block meets those of its own
and the neighbouring size classes only. Tasks return each class's number of
links and a spanning forest, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, free_name, frugal, give_back, hash_words, join_small, materialise, modest_batches, partitions, scratch, table
from .graph import components

N, SIMILARITY = 5, 0.8
RECALL = 0.998
ROWS = 7
BANDS = math.ceil(math.log(1 - RECALL) / math.log(1 - SIMILARITY**ROWS))
BLOCK, BLOCK_GRAMS = 2048, 2_000_000  # classes of a block, and n-grams of 8 bytes
TASK, TASK_GRAMS = 4096, 4_000_000  # what one task compares without cutting
PART_GRAMS = 4 * TASK_GRAMS  # n-grams that one partition should receive
BROADCAST_BYTES = 32 << 20

_GEN = np.random.default_rng(20_260)
_POWERS = _GEN.integers(1, 1 << 63, N, np.int64).astype(np.uint64) | np.uint64(1)
_MULT = (_GEN.integers(1, 1 << 31, ROWS * BANDS, np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)).reshape(-1, 1)
_ADD = _GEN.integers(0, 1 << 32, ROWS * BANDS, np.int64).astype(np.uint32).reshape(-1, 1)


def ngrams(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of words between white space. A
    text of one to n - 1 words is one n-gram; one without words has none."""
    words = (text or "").encode("utf-8", "replace").split()
    if not words:
        return np.zeros(0, np.uint64)
    h = hash_words(words)
    if len(h) < N:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))], np.uint64)
    m = len(h) - N + 1
    g = h[:m] * _POWERS[0]
    for j in range(1, N):
        g += h[j : j + m] * _POWERS[j]
    g ^= g >> np.uint64(29)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(g ^ (g >> np.uint64(32)))


def band_hashes(grams: np.ndarray) -> list[int]:
    low = (grams & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    sig = None
    for at in range(0, len(low), 1024):
        part = (_MULT * low[at : at + 1024] + _ADD).min(axis=1)
        sig = part if sig is None else np.minimum(sig, part)
    raw = sig.tobytes()
    return [xxhash.xxh64_intdigest(raw[4 * ROWS * b : 4 * ROWS * (b + 1)], seed=b) - (1 << 63) for b in range(BANDS)]


def signature(grams: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None


def _signer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            sigs, sizes, bands = [], [], []
            for t in part.column(1):
                g = ngrams(t.as_py())
                sizes.append(len(g))
                sigs.append(signature(g))
                bands.append(band_hashes(g) if len(g) else [])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sigs, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "sig", "n", "bands"])


def _setter(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) becomes (doc_id, sig, grams). Of rows that repeat both id
    and n-grams a task returns one."""
    seen = set()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            keep, sigs, sets = [], [], []
            for i, (id_, t) in enumerate(zip(part.column(0).to_pylist(), part.column(1), strict=True)):
                g = ngrams(t.as_py())
                sig = signature(g)
                if sig is not None and (id_, sig) not in seen:
                    seen.add((id_, sig))
                    keep.append(i)
                    sigs.append(sig)
                    sets.append(g.tobytes())
            if keep:
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep)), pa.array(sigs, pa.binary()), pa.array(sets, pa.binary())], ["doc_id", "sig", "grams"])


def _links(sets: list[np.ndarray], sides: list[int], hubs: np.ndarray, hub: int) -> tuple[np.ndarray, list[int]]:
    """Links of each set, and for each the root of its tree. Two sides: only
    pairs across them count; one side: all pairs. ``hubs`` has a row per set,
    its hub in each band (-1 without): a pair counts here if the first hub that
    it shares is ``hub``."""
    sizes = np.array([len(s) for s in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    side = np.array(sides)
    order = np.argsort(ids, kind="stable")
    posts, starts = owner[order], np.concatenate([[0], np.cumsum(np.bincount(ids))])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    links, root = np.zeros(len(sets), np.int64), list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    two = side.max() > side.min()
    for i in range(len(sets)):
        if two and side[i] != 0:
            continue
        own = ids[bounds[i] : bounds[i + 1]]
        shared = np.zeros(len(sets), np.int64)
        lens = starts[own + 1] - starts[own]
        for a in range(0, len(own), 4096):  # the lists of a slice of its n-grams, end to end
            ln = lens[a : a + 4096]
            total = int(ln.sum())
            at = np.arange(total) + np.repeat(starts[own[a : a + 4096]] - np.concatenate([[0], np.cumsum(ln)[:-1]]), ln)
            shared += np.bincount(posts[at], minlength=len(sets))
        # shared / union >= 4/5, in whole numbers
        near = 9 * shared >= 4 * (sizes + sizes[i])
        near[i] = False
        near[: 0 if two else i] = False
        if two:
            near &= side == 1
        found = np.flatnonzero(near)
        if len(found):
            shares = (hubs[found] == hubs[i]) & (hubs[i] >= 0)
            found = found[shares.any(axis=1) & (hubs[i][shares.argmax(axis=1)] == hub)]
        links[i] += len(found)
        links[found] += 1
        for j in found:
            a, b = find(i), find(int(j))
            if a != b:
                root[max(a, b)] = min(a, b)
    return links, [find(i) for i in range(len(sets))]


def _verify(group: pa.Table) -> pa.Table:
    """Links and forest of one task: (id, links, root) per class and side."""
    out_id, out_links, out_root = [], [], []
    seen: dict[int, dict[tuple, tuple]] = {}
    for comp, side, id_, hubs, grams in zip(*(group.column(c).to_pylist() for c in ("comp", "side", "id", "hubs", "grams")), strict=True):
        seen.setdefault(comp, {})[(id_, side)] = (hubs, grams)
    for comp, members in seen.items():
        keys = sorted(members)
        if len(keys) < 2:
            continue
        hubs = np.array([members[k][0] for k in keys], np.int64)
        links, roots = _links([np.frombuffer(members[k][1], np.uint64) for k in keys], [k[1] for k in keys], hubs, comp)
        for k, n, r in zip(keys, links.tolist(), roots, strict=True):
            if n:
                out_id.append(k[0])
                out_links.append(n)
                out_root.append(keys[r][0])
    seen.clear()
    give_back()
    return pa.table([pa.array(c, pa.int64()) for c in (out_id, out_links, out_root)], names=["id", "links", "root"])


def _tasks(members: DataFrame, grams: int) -> DataFrame:
    """(id, tasks) of ``members`` (id, n, hubs): the tasks a class takes part
    in, each with its hub and the class's side there. A small group is in one
    task, which it shares with others; a large one is cut by size class and
    hash. ``grams``: how many n-grams all groups have."""
    sized = members.select("id", "n", F.floor(F.log("n") / math.log(1 / SIMILARITY)).cast("long").alias("cls"), F.explode(F.array_distinct(F.filter("hubs", lambda h: h >= 0))).alias("comp"))
    large = sized.groupBy("comp").agg(F.count("*").alias("classes"), F.sum("n").alias("grams")).where((F.col("classes") > TASK) | (F.col("grams") > TASK_GRAMS))
    large = materialise(large)
    bins = max(1, -(-grams // TASK_GRAMS))
    small = F.array(F.struct(F.pmod(F.xxhash64("comp"), F.lit(bins)).cast("string").alias("task"), F.col("comp"), F.lit(0).alias("side")))
    if not large.limit(1).count():
        return sized.groupBy("id").agg(F.flatten(F.collect_list(small)).alias("tasks"))
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_GRAMS)).cast("long")
    cells = materialise(sized.join(large, "comp", "left_semi").groupBy("comp", "cls").agg(blocks.alias("blocks")))
    upper = cells.select("comp", (F.col("cls") - 1).alias("cls"), F.col("blocks").alias("above"))
    lower = cells.select("comp", (F.col("cls") + 1).alias("cls"), F.col("blocks").alias("below"))
    around = materialise(cells.join(upper, ["comp", "cls"], "left").join(lower, ["comp", "cls"], "left"))
    placed = sized.join(around, ["comp", "cls"], "left").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")))
    name = lambda c, a, d, b: F.concat_ws("/", F.lit("big"), F.col("comp"), c, a, d, b)
    cls = F.col("cls")
    seq = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).otherwise(F.array().cast("array<bigint>"))
    task = lambda t, side: F.struct(t.alias("task"), F.col("comp"), side.cast("int").alias("side"))
    same = F.transform(seq("blocks"), lambda b: task(name(cls, F.least(b, F.col("mine")), cls, F.greatest(b, F.col("mine"))), b < F.col("mine")))
    up = F.transform(seq("above"), lambda b: task(name(cls, F.col("mine"), cls + 1, b), F.lit(0)))
    down = F.transform(seq("below"), lambda b: task(name(cls - 1, b, cls, F.col("mine")), F.lit(1)))
    each = placed.select("id", F.when(F.col("blocks").isNull(), small).otherwise(F.concat(same, up, down)).alias("tasks"))
    return each.groupBy("id").agg(F.flatten(F.collect_list("tasks")).alias("tasks"))


def _with_sets(docs: DataFrame, members: DataFrame, small: bool, id_col: str) -> DataFrame:
    """(id, hubs, tasks, grams) of each class, from the documents that stand
    for it. The id finds the documents, the signature the class: one id may
    stand for many."""
    side = members.withColumnRenamed("class_id", "doc_id").drop("n")
    ids = side.select("doc_id").distinct()
    if small:
        side, ids = F.broadcast(side), F.broadcast(ids)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi")
    sets = texts.mapInArrow(frugal(_setter), "doc_id long, sig binary, grams binary")
    return sets.join(side, ["doc_id", "sig"]).select("id", "hubs", "tasks", "grams")


def _hubs(classes: DataFrame) -> DataFrame:
    """(id, hubs) of the classes that share a bucket with another one: the hub
    in each band, -1 where there is no other class."""
    placed = classes.select("id", F.posexplode("bands").alias("band", "bucket"))
    hubs = placed.groupBy("bucket").agg(F.min("id").alias("hub"), F.count("*").alias("k")).where("k > 1").drop("k")
    met = placed.join(hubs, "bucket").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("band", "hub"))).alias("by_band"))
    return met.select("id", F.array(*(F.coalesce(F.try_element_at("by_band", F.lit(b)), F.lit(-1).cast("long")) for b in range(BANDS))).alias("hubs"))


def similar_classes(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, classes, linked): rows has ``doc_id``, ``sig``, ``n`` of every
    document; classes has ``sig``, ``id`` (the number of the class) and
    ``class_id`` (its smallest document); linked has ``id``, ``links``,
    ``group_id`` and ``first`` (whether the class stands for its group), for
    the classes that have links.

    Null, empty and blank texts have no signature and rows without an id no
    class; rows that repeat id and text are of one class; an empty table gives
    three empty ones."""
    modest_batches(docs)
    spark = docs.sparkSession
    with scratch(spark) as keep:
        signed = keep(materialise(docs.select(F.col(id_col).cast("long").alias("doc_id"), "text").mapInArrow(frugal(_signer), "doc_id long, sig binary, n long, bands array<long>")))
        some = signed.where("sig IS NOT NULL AND doc_id IS NOT NULL")
        grouped = some.groupBy("sig").agg(F.min("doc_id").alias("class_id"), F.first("n").alias("n"), F.first("bands").alias("bands"))
        classes = keep(materialise(grouped.withColumn("id", F.monotonically_increasing_id())))  # written once, so the numbers stay
        members = materialise(_hubs(classes).join(classes.select("id", "class_id", "n", "sig"), "id"))
        of_all = members.agg(F.sum(F.col("n") * F.size(F.array_distinct("hubs")))).first()[0] or 0
        dealt = materialise(members.join(_tasks(members, of_all), "id"))
        total = dealt.agg(F.count("*"), F.sum(F.size("tasks")), F.sum(F.col("n") * F.size("tasks"))).first()
        small = total[0] * (64 + 8 * BANDS) + (total[1] or 0) * 64 <= BROADCAST_BYTES
        with_sets = _with_sets(docs, dealt, small, id_col)
        each = with_sets.select("id", "hubs", "grams", F.explode("tasks").alias("t")).select("id", "hubs", "grams", "t.*").repartition(partitions(spark, total[2] or 0, PART_GRAMS), "task")
        checked = materialise(each.groupBy("task").applyInArrow(_verify, "id long, links long, root long"))
        forest = components(checked.select(F.col("id").alias("a"), F.col("root").alias("b")))
        counts = checked.groupBy("id").agg(F.sum("links").alias("links"))
        nodes = materialise(counts.join(forest, "id").join(members.select("id", "class_id", "sig"), "id"))
        heads = materialise(nodes.groupBy("root").agg(F.min(F.struct("class_id", "sig")).alias("head")))
        linked = join_small(nodes, heads, ["root"], ["id"]).select("id", "links", F.col("head.class_id").alias("group_id"), (F.col("sig") == F.col("head.sig")).alias("first"))
        return signed.select("doc_id", "sig", "n"), classes.select("sig", "id", "class_id"), keep(materialise(linked))


def _placed(docs: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``join`` with ``sig`` and ``gone``: whether another document
    stands for the row's group."""
    rows, classes, linked = similar_classes(docs, id_col)
    known = F.col("doc_id").isNotNull()
    out = rows.join(classes, "sig", "left").withColumn("id", F.when(known, F.col("id"))).withColumn("class_id", F.when(known, F.coalesce("class_id", "doc_id")))
    out = out.join(linked, "id", "left").withColumn("group_id", F.coalesce("group_id", "class_id"))
    gone = F.coalesce((F.col("doc_id") != F.col("group_id")) | ~F.coalesce("first", F.lit(True)), F.lit(False))
    return out.select("doc_id", "class_id", "group_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.col("n").alias("n_ngrams"), "sig", gone.alias("gone"))


def join(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: ``doc_id``, ``class_id`` (smallest id with the
    same n-grams), ``group_id`` (smallest id that links of similarity 0.8 or
    more lead to), ``n_links`` (other classes linked to its own) and
    ``n_ngrams``.

    A text without words (or null) is a class and group of its own and has no
    links. Repeated rows are of one class. A null id is never linked. Rows
    that share an id but not their n-grams are of different classes.
    """
    return _placed(docs, id_col).drop("sig", "gone")


def keep_one(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents that stand for their groups: of each group the class with
    the smallest id, and of that class the rows with this id.

    Null, empty and blank texts and rows without an id all stay; rows that
    repeat id and text stay or go together; an empty table gives no rows;
    columns of any name may be there beside id and text."""
    gone_id, gone_sig = free_name(docs, "_gone"), free_name(docs, "_gone_sig")
    rows = materialise(_placed(docs, id_col).where("doc_id IS NOT NULL").select("doc_id", "sig", "gone"))
    gone = rows.where("gone").select("doc_id", "sig").distinct()
    mixed = materialise(gone.join(rows.where("NOT gone").select("doc_id").distinct(), "doc_id").select(F.col("doc_id").alias(gone_id), F.col("sig").alias(gone_sig)))
    whole = materialise(gone.select(F.col("doc_id").alias(gone_id)).distinct().join(mixed, gone_id, "left_anti"))
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    key = docs[id_col].cast("long")
    left = docs.join(small(whole), key == F.col(gone_id), "left_anti")
    if not mixed.limit(1).count():
        return left
    # ids of which some rows stay: here the text decides
    ids = small(materialise(mixed.select(gone_id).distinct()))
    own, at = free_name(docs, "_own_sig"), docs.columns.index("text")

    def signed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = pa.array([signature(ngrams(t.as_py())) for t in batch.column(at)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, sigs], names=[*batch.schema.names, own])

    some = left.join(ids, key == F.col(gone_id), "left_semi")
    key = F.col(f"`{id_col}`").cast("long")
    some = some.mapInArrow(frugal(signed), T.StructType([*some.schema.fields, T.StructField(own, T.BinaryType())]))
    some = some.join(small(mixed), (key == F.col(gone_id)) & (F.col(own) == F.col(gone_sig)), "left_anti").drop(own)
    return left.join(ids, docs[id_col].cast("long") == F.col(gone_id), "left_anti").unionByName(some)


def op10_near_join(spark, sf_dir):
    return join(table(spark, sf_dir, "documents"))
