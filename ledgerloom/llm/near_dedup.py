"""Near-duplicate documents by BagMinHash over multisets of five-word shingles.

A shingle with weight w (its count) owns a Poisson process over the weights from 0 to w. Weights are discretised to dyadic intervals
(0, 1], (1, 2], (2, 4], ...; each interval has a process of its own, seeded by shingle and interval, and a point in the topmost interval
counts only if its weight mark lies within w. So two texts share exactly the points below the smaller weight, and the earliest point
of each of the signature's components is the same in both with probability equal to their weighted Jaccard similarity. Points are
drawn up to a time by which all components have very likely been hit; rows that miss one are drawn again up to twice that time.

Texts of equal word sequences are first made one node (128-bit hash, map-side minimum). Signatures are cut into bands; nodes that
share a band are compared through grouping.classes on their whole multisets, and similar ones form a class.

What a bucket's hub leaves unsettled (texts that share a band with many others at, say, 0.7) goes through an exact prefix filter: with
elements in one order, rare ones first, two multisets of sizes x and y can reach the similarity only if they share one of their first
x - o + 1 and y - o + 1 elements, o being the overlap needed. Rarity comes from a sketch of fixed size; any order keeps the filter exact.
Where very many texts share a leading element, those outside the largest class meet the rest in blocks instead of as pairs.

Words are runs of digits, letters and non-ASCII characters, A-Z as a-z. Defined results: a text of fewer words than a shingle is one
shingle; texts without words, null and empty ones among them, are one class; a null doc_id gets a number made from its text; rows that
share a doc_id are judged each by its own text, and a text that isn't the first under its doc_id has a negative number made from its
words as its node; very long texts count whole; an empty table gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import grouping
from ledgerloom.llm.scratch import written
from ledgerloom.llm.words import Words, cut_words, mix64, slices
from ledgerloom.llm.workers import map_batches

_SLICE = 1 << 20
_CHUNK = 1 << 14  # processes drawn from together
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7)


def shingle_bag(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, count), sorted by row: the multiset of each row's shingles, as 64-bit hashes."""
    rows, n = words.rows(), np.diff(words.offsets)
    left = words.offsets[1:][rows] - np.arange(len(rows))  # words of the row from here on
    first = np.flatnonzero((left >= size) | ((n[rows] < size) & (left == n[rows])))
    total = np.zeros(len(first), np.uint64)
    for j in range(size):
        inside = left[first] > j
        at = first[inside] + j
        total[inside] = mix64(total[inside] * _A + words.hashes[at] + np.uint64(j + 1))
    owner = rows[first]
    order = np.lexsort((total, owner))
    total, owner = total[order], owner[order]
    new = (total[1:] != total[:-1]) | (owner[1:] != owner[:-1])
    start = np.flatnonzero(np.concatenate([[True], new])) if len(total) else np.zeros(0, np.int64)
    counts = np.diff(np.concatenate([start, [len(total)]]))
    return owner[start], total[start], counts


def bag_elements(row: np.ndarray, shingle: np.ndarray, count: np.ndarray, n_rows: int) -> list[np.ndarray]:
    """Per row, the multiset as a set of 64-bit numbers: one for the k-th copy of each shingle."""
    copy = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    value = mix64(np.repeat(shingle, count) * _B + copy.astype(np.uint64) * _C).view(np.int64)
    sizes = np.bincount(row, weights=count, minlength=n_rows).astype(np.int64)
    return np.split(value, np.cumsum(sizes)[:-1])


def signatures(row: np.ndarray, shingle: np.ndarray, count: np.ndarray, n_rows: int, m: int) -> np.ndarray:
    """n_rows x m identities of earliest points; rows without shingles are all 0."""
    best = np.full(n_rows * m, np.inf)
    winner = np.zeros(n_rows * m, np.uint64)
    weight = np.bincount(row, weights=count, minlength=n_rows)
    until = np.where(weight > 0, m * (np.log(m) + 5.0) / np.maximum(weight, 1), 0.0)
    pieces, level = [], 0
    while True:  # the dyadic intervals that each weight reaches
        low = 0 if level == 0 else 1 << (level - 1)
        reached = np.flatnonzero(count > low)
        if len(reached) == 0:
            break
        pieces.append((reached, np.full(len(reached), level)))
        level += 1
    if not pieces:
        return np.zeros((n_rows, m), np.uint64)
    element, interval = (np.concatenate(x) for x in zip(*pieces, strict=True))
    low = np.where(interval > 0, 2.0 ** (interval - 1), 0.0)
    length = np.where(interval > 0, low, 1.0)
    owner, limit = row[element], count[element]
    seed = mix64(shingle[element] * _B + interval.astype(np.uint64) * _C + _A)
    wanted = np.ones(n_rows, bool)
    while True:
        todo = np.flatnonzero(wanted[owner])
        for at in range(0, len(todo), _CHUNK):
            _draw(todo[at : at + _CHUNK], seed, low, length, limit, owner, until, m, best, winner)
        wanted = np.isinf(best.reshape(n_rows, m)).any(axis=1) & (weight > 0)
        if not wanted.any():
            return winner.reshape(n_rows, m)
        until[wanted] *= 2
        best.reshape(n_rows, m)[wanted] = np.inf


def _draw(
    active: np.ndarray,
    seed: np.ndarray,
    low: np.ndarray,
    length: np.ndarray,
    limit: np.ndarray,
    owner: np.ndarray,
    until: np.ndarray,
    m: int,
    best: np.ndarray,
    winner: np.ndarray,
) -> None:
    """Draws the points of the active processes up to their rows' times, keeping each component's earliest in best and winner."""
    time, drawn, step = np.zeros(len(active)), 0, 1
    while len(active):
        index = np.arange(drawn, drawn + step, dtype=np.uint64)
        z = mix64(seed[active][:, None] + index[None, :] * _A)
        gaps = -np.log(((z >> np.uint64(11)).astype(float) + 1.0) * 2.0**-53) / length[active][:, None]
        times = time[:, None] + np.cumsum(gaps, axis=1)
        mark = mix64(z ^ _C)
        place = low[active][:, None] + length[active][:, None] * ((mark & np.uint64(0xFFFFFFFF)).astype(float) + 1.0) * 2.0**-32
        good = (times <= until[owner[active]][:, None]) & (np.ceil(place) <= limit[active][:, None])
        slot = owner[active][:, None] * m + ((mark >> np.uint64(32)) % np.uint64(m)).astype(np.int64)
        slot, at, identity = slot[good], times[good], z[good]
        np.minimum.at(best, slot, at)
        won = at == best[slot]
        winner[slot[won]] = identity[won]
        time = times[:, -1]
        alive = time <= until[owner[active]]
        active, time = active[alive], time[alive]
        drawn, step = drawn + step, 1 if drawn < 3 else 32


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    n, m = signature.shape
    parts = signature.reshape(n, bands, m // bands)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _C, (n, bands)).copy()
    for j in range(parts.shape[2]):
        keys = mix64(keys * _A + parts[:, :, j])
    return keys.view(np.int64)


def _sequence_hashes(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each row's word sequence."""
    place = (np.arange(len(words.hashes)) - np.repeat(words.offsets[:-1], np.diff(words.offsets))).astype(np.uint64)
    out = []
    for salt in (_B, _C):
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(words.hashes ^ mix64(place * _A + salt)), dtype=np.uint64)])
        out.append((running[words.offsets[1:]] - running[words.offsets[:-1]]).view(np.int64))
    return out[0], out[1]


def node_id() -> Column:
    """doc_id, or a negative number from the text where it is null."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-1) - F.shiftrightunsigned(F.xxhash64("text"), 1))


def _signed(docs: DataFrame, shingle: int, bands: int, rows_per_band: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column(2), _SLICE):
                words, n = cut_words(batch.column(2)[low:high]), high - low
                bag = shingle_bag(words, shingle)
                keys = band_keys(signatures(*bag, n, bands * rows_per_band), bands)
                c1, c2 = _sequence_hashes(words)
                full = np.diff(words.offsets) > 0
                columns = [*(batch.column(c)[low:high] for c in (0, 1, 3)), pa.array(c1), pa.array(c2)]
                columns.append(pa.array([k if f else [] for k, f in zip(keys, full, strict=True)], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "id", "th", "c1", "c2", "keys"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), node_id().alias("id"), "text", F.xxhash64("text").alias("th"))
    return map_batches(rows, run, "doc_id long, id long, th long, c1 long, c2 long, keys array<long>")


def _elements(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, elements) of (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column(1), _SLICE):
                sets = bag_elements(*shingle_bag(cut_words(batch.column(1)[low:high]), shingle), high - low)
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], pa.array(sets, pa.list_(pa.int64()))], ["node", "elements"])

    return map_batches(texts, run, "node long, elements array<long>")


_SKETCH, _SLOTS = 1 << 20, 1 << 22
_STEP = 1.05


def _size_class(n: int) -> int:
    return int(np.floor(np.log(n) / np.log(_STEP) + 1e-9))


def prefix_keys(elements: np.ndarray, sketch: np.ndarray, similarity: float) -> np.ndarray:
    """Keys of a multiset's leading elements, for each class of partner sizes; elements that no other text has are left out."""
    own = np.unique(elements)
    n = len(own)
    count = sketch[own & (_SKETCH - 1)]
    order = np.lexsort((own, count))
    shared = count[order] > 1
    own_class, keys = _size_class(n), []
    least, most = int(np.ceil(similarity * n - 1e-9)), int(np.floor(n / similarity + 1e-9))
    for partner in range(_size_class(max(1, least)), _size_class(most) + 1):
        smallest = max(least, int(np.ceil(_STEP**partner - 1e-6)))
        overlap = int(np.ceil(similarity / (1 + similarity) * (n + smallest) - 1e-9))
        lead = order[: max(0, n - overlap + 1)]
        lead = lead[shared[: len(lead)]]
        pair = mix64(np.array([min(own_class, partner) * 4096 + max(own_class, partner)], np.uint64))
        keys.append(mix64(own[lead].view(np.uint64) * _A + pair))
    return np.concatenate(keys).view(np.int64)


def _open_links(open_nodes: DataFrame, sets: DataFrame, similarity: float, compare: Callable[[DataFrame], DataFrame], hot: int = 64) -> DataFrame:
    """The links (a, b) between open nodes of different labels.

    Nodes that share a prefix key with at most `hot` others are paired; for fuller keys see _block_links.
    """
    held = written(sets.join(open_nodes, "node").select("node", "label", "elements"), "open-elements")
    slot = F.explode("elements").alias("e")
    slots = held.select(slot).groupBy(F.col("e").bitwiseAND(F.lit(_SKETCH - 1)).alias("slot")).agg(F.count("*").alias("n")).toArrow()  # _SKETCH rows at most
    sketch = np.zeros(_SKETCH, np.uint32)
    sketch[slots.column("slot").to_numpy()] = np.minimum(slots.column("n").to_numpy(), 2**32 - 1)
    shared = held.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.unique(prefix_keys(e, shared.value, similarity)) if len(e) else np.zeros(0, np.int64) for e in _lists(batch.column(2))]
            place = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]))
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([flat, batch.column(0).take(place), batch.column(1).take(place)], ["key", "node", "label"])

    leads = written(map_batches(held, run, "key long, node long, label long"), "prefix-keys")
    by_label = leads.groupBy("key", "label").agg(F.count("*").alias("n"))
    main = F.max_by("label", F.struct("n", "label")).alias("main")
    mixed = by_label.groupBy("key").agg(main, F.count("*").alias("labels"), F.sum("n").alias("n")).filter("labels > 1")
    met = written(leads.join(written(mixed.select("key", "main", "n"), "mixed-keys"), "key"), "mixed-leads")
    cold = met.filter(F.col("n") <= hot)
    fewer = cold.filter("label <> main").select("key", F.col("node").alias("leader"), F.col("label").alias("leader_label"))
    pairs = cold.join(fewer, "key").filter("label <> leader_label").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"))
    links = compare(written(pairs.distinct(), "rivals"))
    warm = met.filter(F.col("n") > hot).select("key", "node", "label", "main")
    return links.union(_block_links(warm, held, similarity))


def _lists(column: pa.Array) -> list[np.ndarray]:
    values, bounds = column.values.to_numpy(), column.offsets.to_numpy()
    return [values[i:j] for i, j in zip(bounds[:-1], bounds[1:], strict=True)]


def _overlapping(asking: pa.Table, asked: pa.Table, similarity: float) -> pa.Table:
    """The similar pairs (a, b) of different labels of two blocks (node, label, elements): one is inverted, the other's overlaps counted."""
    asking, asked = asking.combine_chunks(), asked.combine_chunks()
    a, b = [], []
    if asking.num_rows and asked.num_rows:
        nodes, labels = (asking.column(c).to_numpy() for c in ("node", "label"))
        own = [np.unique(e) for e in _lists(asking.column("elements").chunk(0))]
        sizes = np.array([len(e) for e in own])
        values, owner = np.concatenate(own), np.repeat(np.arange(len(own)), sizes)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        others = zip(asked.column("node").to_pylist(), asked.column("label").to_pylist(), _lists(asked.column("elements").chunk(0)), strict=True)
        for node, label, elements in others:
            e = np.unique(elements)
            low, high = np.searchsorted(values, e, "left"), np.searchsorted(values, e, "right")
            many = high - low
            at = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many - low, many)
            common = np.bincount(owner[at], minlength=len(own))
            near = np.flatnonzero((common >= similarity * (sizes + len(e) - common)) & (labels != label))
            a += np.minimum(nodes[near], node).tolist()
            b += np.maximum(nodes[near], node).tolist()
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _block_links(warm: DataFrame, held: DataFrame, similarity: float, block_elements: int = 500_000) -> DataFrame:
    """The links (a, b) of the nodes outside their key's main label (asking) with all that share a very common key with them (asked).

    warm has (key, node, label, main), held (node, label, elements). Asking and asked texts are hashed into blocks of about block_elements;
    an asked text goes only to the blocks that ask for one of its keys, and two blocks meet in one group of a shuffle. So a group holds
    two blocks whatever the number of texts, and only links become rows.
    """
    asking_keys = written(warm.filter("label <> main").select("key", "node").distinct(), "asking-keys")
    asked_keys = written(warm.select("key", "node").distinct(), "asked-keys")
    asking = written(held.join(asking_keys.select("node").distinct(), "node").select("node", "label", "elements"), "asking")
    asked = written(held.join(asked_keys.select("node").distinct(), "node").select("node", "label", "elements"), "asked")
    n_asking, n_asked = (1 + (t.agg(F.sum(F.size("elements"))).first()[0] or 0) // block_elements for t in (asking, asked))
    block, part = F.pmod(F.xxhash64(F.lit(1), "node"), F.lit(n_asking)).alias("block"), F.pmod(F.xxhash64(F.lit(2), "node"), F.lit(n_asked)).alias("part")
    wanted = asked_keys.join(asking_keys.select("key", block).distinct(), "key").select("node", "block").distinct()
    left = asking.select(block, F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1)).cast("array<long>")).alias("part"), "node", "label", "elements")
    right = asked.join(wanted, "node").select("block", part, "node", "label", "elements")
    met = left.groupBy("block", "part").cogroup(right.groupBy("block", "part"))
    return met.applyInArrow(lambda x, y: _overlapping(x, y, similarity), "a long, b long").distinct()


def _asked_only(texts: DataFrame, candidates: DataFrame) -> DataFrame:
    """The rows of texts (id, ...) whose id is a candidate's, and a few more: the others are told apart by a broadcast table of _SLOTS hashes
    of ids at most, whatever the number of candidates, so that no join moves their texts."""
    slot = F.pmod(F.xxhash64("id"), F.lit(_SLOTS))
    return texts.join(F.broadcast(candidates.select(slot.alias("slot")).distinct()), slot == F.col("slot"), "left_semi")


def near_duplicates(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, bands: int = 20, rows_per_band: int = 6) -> DataFrame:
    """(doc_id, id, class_id) of every document row; class_id is the smallest id of its class.

    With 20 bands of 6, a pair at 0.8 shares a band with probability 0.998, and classes need only one path of such pairs.
    """
    return _placed_classes(docs, similarity, shingle, bands, rows_per_band).select("doc_id", "id", "class_id")


def _placed_classes(docs: DataFrame, similarity: float, shingle: int, bands: int, rows_per_band: int) -> DataFrame:
    """(doc_id, id, th, node, class_id) of every row: its number, text hash, the number of its word sequence, and that of its class."""
    signed = written(_signed(docs, shingle, bands, rows_per_band), "signatures")
    nodes = grouping.number_nodes(signed, ["c1", "c2"], ["th"])
    placed = written(signed.select("doc_id", "id", "th", "c1", "c2").join(nodes.select("c1", "c2", "node"), ["c1", "c2"]).select("doc_id", "id", "th", "node"), "placed")
    chosen = nodes.select("node", "id", "th")
    own = signed.select("id", "th", "keys").join(chosen, ["id", "th"]).dropDuplicates(["id", "th"])
    members = own.select(F.explode(F.array_distinct("keys")).alias("key"), "node")
    buckets = grouping.shared_buckets(members)
    candidates = written(buckets.select("node").distinct().join(chosen, "node"), "candidates")
    repeated = written(signed.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id"), "repeated-ids")
    # An id of one row tells its text by itself, so narrow ids prune the texts; what is repeated is looked up by its text's hash too.
    place = _asked_only(docs.select(node_id().alias("id"), F.xxhash64("text").alias("th"), "text"), candidates)
    single = place.join(candidates.select("id").join(repeated, "id", "left_anti"), "id", "left_semi").select(F.col("id").alias("node"), "text")
    several = place.join(candidates.join(repeated, "id", "left_semi"), ["id", "th"]).dropDuplicates(["id", "th"]).select("node", "text")
    sets = written(_elements(single.unionByName(several), shingle), "elements")

    def compare(pairs: DataFrame) -> DataFrame:
        left, right = (sets.select(F.col("node").alias(n), F.col("elements").alias(f"{n}_set")) for n in ("a", "b"))
        met = pairs.join(left, "a").join(right, "b")
        common = F.size(F.array_intersect("a_set", "b_set"))
        union = F.size("a_set") + F.size("b_set") - common
        return met.filter(common >= union * F.lit(similarity)).select("a", "b").distinct()

    labels = grouping.classes(buckets, compare, lambda nodes: _open_links(nodes, sets, similarity, compare))
    joined = placed.join(labels.withColumnRenamed("label", "class"), "node", "left")
    return joined.select("doc_id", "id", "th", "node", F.coalesce("class", "node").alias("class_id"))


def keep_one(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, bands: int = 20, rows_per_band: int = 6) -> DataFrame:
    """The documents, all columns, with one row of each class: of its first node's rows that with the smallest number, then text hash.

    Rows equal in both are told apart by a hash of all columns; rows alike in everything are one.
    """
    found = _placed_classes(docs, similarity, shingle, bands, rows_per_band).filter("node = class_id")
    counted = found.groupBy("node", "id", "th").agg(F.count("*").alias("n"))
    first = counted.groupBy("node").agg(F.min(F.struct("id", "th", "n")).alias("k"))
    kept = written(first.select(F.col("k.id").alias("id"), F.col("k.th").alias("th"), F.col("k.n").alias("n")), "kept")
    # The whole row is one struct, so no name of its columns can meet those used here.
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(whole, node_id().alias("id"), F.xxhash64("text").alias("th")).join(kept, ["id", "th"])
    single = rows.filter("n = 1").select("row")
    if not kept.filter("n > 1").isEmpty():
        single = single.union(rows.filter("n > 1").groupBy("id", "th").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row"))
    return single.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
