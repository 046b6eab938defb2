"""Benchmark decontamination with an FM-index per training shard.

A shard is a slice of a partition, about shard_bytes of text or one longer document. Its words become symbols of the benchmark's
vocabulary; a symbol sequence gets a suffix array, its Burrows-Wheeler transform in a wavelet matrix, and sampled suffix
positions. All benchmark windows are searched backward at once through wavelet ranks; the rows of their final intervals are
located by walking to the next sampled position; overlapping occurrences merge into removal spans.

Before indexing, a shard is cut to stretches whose neighbouring words are neighbours in some window (single words where a
window has one word): no occurrence can lie outside them, so the result is unchanged and clean text costs little.

Nothing is shuffled. The benchmark is the stated query set: it is cut by item hash into blocks of about block_bytes, each block's
windows are built once and broadcast as flat arrays in a pass of its own over the documents, and the passes' spans are merged per
document. An ordinary benchmark is one block. Very long stretches are indexed in overlapping pieces, so memory follows neither them
nor the benchmark.

Defined results: null text has no words; an item without words has no window; a null item_id is named ''; rows that repeat a doc_id or
an item_id count each; very long texts count whole; an empty table of documents gives no rows, one of items hits nothing; extra columns,
whatever their names, are ignored; word identity is by 64-bit hash, window identity by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.words import cut_words, mix64, slices
from ledgerloom.llm.workers import map_batches

_MARK = np.uint64(0x9E3779B97F4A7C15)
_PIECE = 1 << 19  # symbols indexed together
_CHUNK = 1 << 18  # windows searched together


class Windows:
    """The distinct windows of a benchmark block, and the items that hold each, as flat arrays: about 5 bytes for each byte of text.

    A window is a range of `words`, the items' words as symbols 1..V: it ends before ends[i] and has lengths[i] of them.
    """

    def __init__(self, item_ids: list[str], texts: pa.Array, size: int):
        cut = cut_words(texts)
        self.items, self.size = item_ids, size
        self.vocabulary = np.unique(cut.hashes)
        self.words = np.searchsorted(self.vocabulary, cut.hashes).astype(np.int32) + 1
        n = np.diff(cut.offsets)
        per = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
        item = np.repeat(np.arange(len(n), dtype=np.int32), per)
        start = np.arange(len(item)) - np.repeat(np.cumsum(per) - per - cut.offsets[:-1], per)
        length = np.minimum(n, size)[item]
        marks = [np.full(len(item), salt, np.uint64) for salt in (1, 2)]
        for j in range(size):
            inside = np.flatnonzero(length > j)
            word = self.words[start[inside] + j].astype(np.uint64)
            for mark in marks:
                mark[inside] = mix64(mark[inside] * _MARK + word)
        order = np.lexsort((item, *marks))
        new = np.concatenate([np.ones(min(1, len(order)), bool), np.any([m[order[1:]] != m[order[:-1]] for m in marks], axis=0)])
        new_item = new | np.concatenate([np.ones(min(1, len(order)), bool), item[order[1:]] != item[order[:-1]]])
        first = order[new]
        self.lengths = length[first].astype(np.int32)
        self.ends = (start[first] + length[first]).astype(np.int32)
        self.holders = item[order[new_item]]
        self.holder_starts = np.concatenate([np.flatnonzero(new[new_item]), [len(self.holders)]]).astype(np.int32)
        self.base = len(self.vocabulary) + 1
        rows = cut.rows()
        left, right = self.words[:-1].astype(np.int64), self.words[1:].astype(np.int64)
        self.neighbours = np.unique((left * self.base + right)[rows[1:] == rows[:-1]])
        self.singles = np.unique(self.words[cut.offsets[:-1][n == 1]])
        self.shortest = int(self.lengths.min()) if len(first) else 0
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """0 for words outside the benchmark."""
        out = np.zeros(len(hashes), np.int32)
        maybe = np.flatnonzero(self.sieve[(hashes >> np.uint64(44)).astype(np.int64)])
        at = np.searchsorted(self.vocabulary, hashes[maybe])
        at[at == len(self.vocabulary)] = 0
        hit = self.vocabulary[at] == hashes[maybe]
        out[maybe[hit]] = at[hit] + 1
        return out

    def stretches(self, symbols: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end positions of the stretches that may hold an occurrence."""
        empty = np.zeros(0, np.int64)
        if len(symbols) == 0 or self.shortest == 0:
            return empty, empty
        linked = np.zeros(len(symbols), bool)  # with the next word
        both = np.flatnonzero((symbols[:-1] > 0) & (symbols[1:] > 0) & (rows[:-1] == rows[1:]))
        linked[both] = np.isin(symbols[both].astype(np.int64) * self.base + symbols[both + 1], self.neighbours)
        after = np.concatenate([[False], linked[:-1]])
        inside = linked | after
        if len(self.singles):
            inside |= np.isin(symbols, self.singles)
        first = np.flatnonzero(inside & ~after)
        end = np.flatnonzero(inside & ~linked) + 1
        long = end - first >= self.shortest
        return first[long], end[long]


class FMIndex:
    """Backward search and location over a sequence of symbols, in which 0 ends each stretch."""

    def __init__(self, sequence: np.ndarray, symbols: int, sample: int = 16):
        n = len(sequence)
        self.suffixes = _suffix_array(sequence)
        transform = sequence[self.suffixes - 1]
        self.transform = transform
        counts = np.bincount(sequence, minlength=symbols + 1)
        self.first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.levels = []
        current = transform
        for bit in range(max(1, int(symbols).bit_length()) - 1, -1, -1):
            ones = (current >> bit) & 1
            ranks = np.zeros(n + 1, np.int32)
            np.cumsum(ones, out=ranks[1:])
            self.levels.append((bit, n - int(ranks[-1]), ranks))
            is_one = ones.astype(bool)
            current = np.concatenate([current[~is_one], current[is_one]])
        starts_stretch = np.concatenate([[True], sequence[:-1] == 0])
        sampled = (starts_stretch | (np.arange(n) % sample == 0))[self.suffixes]
        self.sampled = sampled
        self.sample_rank = np.cumsum(sampled) - 1
        self.samples = self.suffixes[sampled]
        del self.suffixes

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the transform before a row."""
        begin = np.zeros(len(row), np.int64)
        for bit, zeros, ranks in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            begin_ones, row_ones = ranks[begin], ranks[row]
            begin = np.where(one, zeros + begin_ones, begin - begin_ones)
            row = np.where(one, zeros + row_ones, row - row_ones)
        return row - begin

    def search(self, words: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern, low, high) of the patterns that occur; pattern i is words[ends[i] - lengths[i]:ends[i]]."""
        last = words[ends - 1]
        low, high = self.first[last], self.first[last + 1]
        which = np.flatnonzero(low < high)
        low, high = low[which], high[which]
        for back in range(2, int(lengths.max(initial=1)) + 1):
            more = np.flatnonzero(lengths[which] >= back)
            symbol = words[ends[which[more]] - back]
            low[more] = self.first[symbol] + self.rank(symbol, low[more])
            high[more] = self.first[symbol] + self.rank(symbol, high[more])
            alive = low < high
            which, low, high = which[alive], low[alive], high[alive]
        return which, low, high

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text positions of rows, each by stepping back to the nearest sampled suffix."""
        out, todo, steps = np.zeros(len(row), np.int64), np.arange(len(row)), 0
        while len(todo):
            known = self.sampled[row]
            out[todo[known]] = self.samples[self.sample_rank[row[known]]] + steps
            todo, row, steps = todo[~known], row[~known], steps + 1
            symbol = self.transform[row]
            row = self.first[symbol] + self.rank(symbol, row)
        return out


def _suffix_array(sequence: np.ndarray) -> np.ndarray:
    """By prefix doubling; each 0 is a symbol of its own, lower for an earlier place, so no comparison passes one."""
    n = len(sequence)
    ends = sequence == 0
    rank = np.where(ends, np.cumsum(ends) - 1, int(ends.sum()) + sequence.astype(np.int64))
    step = 1
    order = np.argsort(rank, kind="stable")
    while True:
        following = np.zeros(n, np.int64)
        following[:-step or None] = rank[step:] + 1 if step < n else 0
        key = rank * np.int64(2 * n + int(sequence.max(initial=0)) + 2) + following
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if n == 0 or new[-1] == n - 1:
            return order
        step *= 2


def _pieces(first: np.ndarray, end: np.ndarray, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches cut to _PIECE words and what a window that starts there needs beyond: (first, end, first word that isn't the piece's own)."""
    many = np.maximum(1, -(-(end - first - overlap) // _PIECE))
    number = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    begin, stop = np.repeat(first, many) + number * _PIECE, np.repeat(end, many)
    is_last = number == np.repeat(many - 1, many)
    return begin, np.where(is_last, stop, begin + _PIECE + overlap), np.where(is_last, stop, begin + _PIECE)


def occurrences(windows: Windows, hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, first word) of every occurrence in a shard's words; indexes hold about _PIECE words whatever the shard's size."""
    symbols = windows.symbols(hashes)
    first, end, own = _pieces(*windows.stretches(symbols, rows), windows.size - 1)
    group = np.cumsum(end - first + 1) // _PIECE
    found, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for cut in np.split(np.arange(len(first)), np.flatnonzero(np.diff(group)) + 1):
        if len(cut):
            which, at = _in_pieces(windows, symbols, first[cut], end[cut], own[cut])
            found.append(which)
            places.append(at)
    return np.concatenate(found), np.concatenate(places)


def _in_pieces(windows: Windows, symbols: np.ndarray, first: np.ndarray, end: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = end - first + 1
    starts = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(starts - first, sizes)  # of each symbol in the shard; ends hold a 0
    is_end = np.zeros(len(place), bool)
    is_end[starts + sizes - 1] = True
    sequence = np.where(is_end, 0, symbols[np.minimum(place, len(symbols) - 1)]).astype(np.int32)
    index, until = FMIndex(sequence, windows.base - 1), np.repeat(own, sizes)
    found, places = [], []
    for at in range(0, len(windows.lengths), _CHUNK):
        which, low, high = index.search(windows.words, windows.ends[at : at + _CHUNK], windows.lengths[at : at + _CHUNK])
        many = high - low
        located = index.locate(np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many - low, many))
        mine = place[located] < until[located]
        found.append((np.repeat(which, many) + at)[mine])
        places.append(place[located][mine])
    return np.concatenate(found), np.concatenate(places)


def _merge(positions: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of neighbouring hit words of one row: (first, end)."""
    cut = np.flatnonzero((np.diff(positions) != 1) | (np.diff(rows[positions]) != 0)) + 1
    return positions[np.concatenate([[0], cut])], positions[np.concatenate([cut - 1, [len(positions) - 1]])] + 1


def _scan(windows: Windows, texts: pa.Array) -> tuple[list, list, list]:
    """n_words, spans and items of each text."""
    words = cut_words(texts)
    rows, n = words.rows(), len(texts)
    spans: list[list] = [[] for _ in range(n)]
    items: list[list] = [[] for _ in range(n)]
    which, at = occurrences(windows, words.hashes, rows)
    if len(which):
        change = np.zeros(len(rows) + 1, np.int64)
        np.add.at(change, at, 1)
        np.add.at(change, at + windows.lengths[which], -1)
        hit = np.flatnonzero(np.cumsum(change[:-1]) > 0)
        for first, end in zip(*_merge(hit, rows), strict=True):
            row = rows[first]
            spans[row].append({"start": int(first - words.offsets[row]), "end": int(end - words.offsets[row])})
        pairs = np.unique(rows[at] * np.int64(len(windows.lengths)) + which)
        for row, window in zip(pairs // len(windows.lengths), pairs % len(windows.lengths), strict=True):
            items[row] += [windows.items[i] for i in windows.holders[windows.holder_starts[window] : windows.holder_starts[window + 1]]]
    return np.diff(words.offsets).tolist(), spans, [sorted(set(x)) for x in items]


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_OUT = "doc_id long, th long, n_words long, spans array<struct<start:int,end:int>>, items array<string>"


def _shared_windows(block: DataFrame, window: int) -> Broadcast:
    """A block's windows, built once on the driver; each worker loads them once."""
    rows = block.toArrow()
    windows = Windows(rows.column("item_id").to_pylist(), rows.column("text").combine_chunks().cast(pa.large_string()), window)
    return block.sparkSession.sparkContext.broadcast(windows)


def _one_pass(docs: DataFrame, block: DataFrame, window: int, shard_bytes: int) -> DataFrame:
    shared = _shared_windows(block, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        for batch in batches:
            for low, high in slices(batch.column(2), shard_bytes):
                n_words, spans, items = _scan(windows, batch.column(2)[low:high])
                columns = [batch.column(0)[low:high], batch.column(1)[low:high], pa.array(n_words, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "n_words", "spans", "items"])

    return map_batches(docs.selectExpr("CAST(doc_id AS long) AS doc_id", "xxhash64(text) AS th", "text"), run, _OUT)


def _merged(spans: Column) -> Column:
    """Sorted spans with those that touch or overlap made one."""
    kind = "array<struct<start:int,end:int>>"

    def add(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        longer = F.named_struct(F.lit("start"), last["start"], F.lit("end"), F.greatest(last["end"], s["end"]))
        joins = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= s["start"])
        return F.when(joins, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(F.sort_array(spans), F.array().cast(kind), add)


def _item_blocks(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))
    block_of = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks))
    return [items.filter(block_of == b) for b in range(n_blocks)]


def find_overlaps(docs: DataFrame, benchmark: DataFrame, window: int = 13, shard_bytes: int = 4 << 20, block_bytes: int = 16 << 20) -> DataFrame:
    """(doc_id, th, n_words, spans, items) of each document: hit words as merged [start, end) spans, and the ids of the items found."""
    blocks = _item_blocks(benchmark, block_bytes)
    passes = [_one_pass(docs, block, window, shard_bytes) for block in blocks]
    if len(blocks) == 1:
        return passes[0]
    together = passes[0]
    for more in passes[1:]:
        together = together.unionByName(more)
    summed = together.groupBy("doc_id", "th").agg(
        (F.count("*") / len(blocks)).cast("int").alias("copies"),
        F.first("n_words").alias("n_words"),
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return summed.select("doc_id", "th", "n_words", _merged(F.col("spans")).alias("spans"), "items", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).drop("copy")


def judge(overlaps: DataFrame) -> DataFrame:
    """overlaps with n_hit and contaminated: some word is hit, and at least one word in twenty."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]).cast("long"))
    return overlaps.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, shard_bytes: int = 4 << 20, block_bytes: int = 16 << 20) -> DataFrame:
    """The documents, all columns, that are not contaminated. With one benchmark block no text is shuffled."""
    blocks = _item_blocks(benchmark, block_bytes)
    if len(blocks) > 1:
        bad = judge(find_overlaps(docs, benchmark, window, shard_bytes, block_bytes)).filter("contaminated")
        bad = bad.select(F.col("doc_id").alias("b_id"), F.col("th").alias("b_th")).distinct()
        same = docs.doc_id.cast("long").eqNullSafe(bad.b_id) & (F.xxhash64(docs.text) == bad.b_th)
        return docs.join(bad, same, "left_anti")
    shared = _shared_windows(blocks[0], window)
    column = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        for batch in batches:
            for low, high in slices(batch.column(column), shard_bytes):
                n_words, spans, _ = _scan(windows, batch.column(column)[low:high])
                hits = [sum(s["end"] - s["start"] for s in found) for found in spans]
                clean = [h == 0 or 20 * h < n for h, n in zip(hits, n_words, strict=True)]
                yield batch.slice(low, high - low).filter(pa.array(clean, pa.bool_()))

    return map_batches(docs, run, docs.schema)
