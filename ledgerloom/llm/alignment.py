"""Alignment of two tokenizers' tokens on the bytes of a text, with corpus-wide counts of id pairs.

Tokenizer A is a byte-level BPE file over a space and the text, B a sentencepiece model over the text (it adds the space itself). Offsets at
which tokens of both end cut the tokens into groups; the A and the B token that end there are a link.

No token of either reaches from other characters into white space, so a text is cut before white space and each stretch is aligned by
itself. A task gathers texts into slices of bounded size. DuckDB aligns a slice's distinct stretches: their tokens are two interval tables on
one line of bytes; they meet where tokens end together, ASOF joins find each token's group and each group's stretch, windows over the ends
tell where a token stands among its group's, and joins with the texts' stretches give each text's links. Out of a slice come its texts' rows, with links as numbers of the
slice's own pairs, and the slice's pair counts. Spark adds up the counts, finds each B id's highest, and sends every slice the counts of its
pairs, which its texts' links are then summed over. So no row is shuffled by a pair that every text holds; a pair comes once a slice.

Defined results: texts that are null or empty, or whose A or B bytes aren't the space and the text (as where a text holds the character
that B writes for a space), have no tokens: zeros, no groups, and no share in any count. Strings of special tokens are plain text. Rows that
repeat a doc_id each get a row and each count. A text longer than a slice goes through several, its groups put together in order; a stretch
without white space is not cut, and takes about 500 bytes a token while it is aligned. An empty table gives no rows; extra columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.bpe import WHITE_SPACE, PrefixEncoder, Settled, byte_characters
from ledgerloom.llm.scratch import written
from ledgerloom.llm.token_counts import PATTERN, check_file
from ledgerloom.llm.workers import give_back, map_batches

_SLICE_CHARS, _SLICE_TOKENS, _SLICE_TEXTS, _LONG, _CACHED, _LONGEST_CACHED = 6 << 20, 2_000_000, 100_000, 1 << 20, 300_000, 64
_SPACE = "▁"
#: A stretch without tokens: no ids of A, and none of B.
_WITHOUT = array("i", [0]).tobytes()

_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
_ROW = pa.schema(
    [
        ("slice", pa.int64()),
        ("row", pa.int64()),
        ("doc_id", pa.int64()),
        *[(c, pa.int64()) for c in _COUNTS],
        ("groups", pa.string()),
        ("link_pairs", pa.binary()),
        ("link_counts", pa.binary()),
        ("a", pa.list_(pa.int32())),
        ("b", pa.list_(pa.int32())),
        ("held", pa.list_(pa.int64())),
    ]
)
_ROW_DDL = (
    "slice long, row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, "
    "link_pairs binary, link_counts binary, a array<int>, b array<int>, held array<long>"
)


class Pair:
    """Both tokenizers, the sizes of their tokens in bytes, and this worker's cache of stretches."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        ranks = byte_ranks(path_a)
        self.quick_a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.is_settled = Settled()
        self.a_sizes = [0] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_sizes[i] = len(token)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_sizes = [1 if self.b.is_byte(i) else len(p.replace(_SPACE, " ").encode()) for i, p in enumerate(pieces)]
        self.b_space = self.b.piece_to_id(_SPACE)
        self.cut = stretch_pattern(pieces).findall
        self.cut_lazily = stretch_pattern(pieces).finditer
        separators = (",", ";", "|")
        self.told = pa.array([f"{mark}{i}" for mark in separators for i in range(self.told_size)], pa.large_string())
        self.cache: dict[str, bytes] = {}

    @property
    def told_size(self) -> int:
        return max(len(self.a_sizes), len(self.b_sizes))

    def stretches(self, text: str) -> Iterator[list[str]]:
        """The stretches of a space and a text; those of a very long one in lists of bounded length."""
        spaced = " " + text
        if len(spaced) <= _LONG:
            yield self.cut(spaced)
            return
        found = (m[0] for m in self.cut_lazily(spaced))
        while part := list(islice(found, _LONG // 8)):
            yield part

    def encode_a(self, stretch: str) -> list[int]:
        """By the same merges either way; on the classes of young characters the quick library and the file's own may differ."""
        if stretch.isascii() or self.is_settled(stretch):
            return self.quick_a(stretch)
        return self.a.encode(stretch, add_special_tokens=False).ids

    def encode_b(self, stretches: list[str]) -> list[list[int]]:
        """B adds a space to what it gets: to one that begins with a space in that space's place; to another one it is a token of its own,
        as no piece joins it with the white space that follows."""
        found = self.b.encode([s.removeprefix(" ") for s in stretches], num_threads=1)
        return [(ids or [self.b_space]) if s[0] == " " else ids[1:] for s, ids in zip(stretches, found, strict=True)]

    def encode(self, stretches: list[str]) -> list[bytes]:
        """Of each stretch, as 32-bit integers: the number of A ids, the A ids, the B ids; without tokens where bytes differ."""
        out, a_size, b_size = [], self.a_sizes.__getitem__, self.b_sizes.__getitem__
        for s, a, b in zip(stretches, map(self.encode_a, stretches), self.encode_b(stretches), strict=True):
            n = len(s) if s.isascii() else len(s.encode())
            # Neither rewrites a text, but for the character that B writes for a space: bytes differ where their numbers do.
            same = sum(map(a_size, a)) == n == sum(map(b_size, b))
            out.append(array("i", [len(a), *a, *b]).tobytes() if same else _WITHOUT)
        return out

    def ids(self, stretches: list[str]) -> list[bytes]:
        found = list(map(self.cache.get, stretches))
        if None in found:
            missing = [s for s, ids in zip(stretches, found, strict=True) if ids is None]
            fresh = dict(zip(missing, self.encode(missing), strict=True))
            if len(self.cache) + len(fresh) > _CACHED:
                self.cache.clear()
            self.cache.update((s, ids) for s, ids in fresh.items() if len(s) <= _LONGEST_CACHED)
            found = [fresh[s] if ids is None else ids for s, ids in zip(stretches, found, strict=True)]
        return found


@lru_cache(1)
def byte_ranks(path_a: str) -> dict[bytes, int]:
    """A's tokens as bytes with their ids, if merging any neighbours that make a token, lowest id first, is what the file's merges do.

    It is where ids follow the order of merges and every token comes out of its own text: neighbours that make a token, with no merge
    across its ends, have gone through the merges of its own text, which end in that token by the file's own pair.
    """
    check_file(path_a)
    with open(path_a, encoding="utf-8") as f:
        told = json.load(f)["model"]
    vocabulary, merges = told["vocab"], [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in told["merges"]]
    made = [vocabulary[a + b] for a, b in merges]
    if made != sorted(made) or len(PrefixEncoder(vocabulary, merges, "").lone) != len(vocabulary):
        raise ValueError(f"{path_a} has ids that don't follow its merges")
    to_byte = {c: b for b, c in enumerate(byte_characters())}
    return {bytes(map(to_byte.__getitem__, token)): i for token, i in vocabulary.items()}


def check_model(path_b: str) -> None:
    """Raises where the sentencepiece model isn't a BPE that adds a space and otherwise leaves texts as they are."""
    from sentencepiece import sentencepiece_model_pb2

    told = sentencepiece_model_pb2.ModelProto()
    with open(path_b, "rb") as f:
        told.ParseFromString(f.read())
    rule = told.normalizer_spec
    plain = rule.name == "identity" and rule.add_dummy_prefix and not rule.remove_extra_whitespaces and rule.escape_whitespaces
    if not plain or told.trainer_spec.model_type != told.trainer_spec.BPE or not told.trainer_spec.byte_fallback:
        raise ValueError(f"{path_b} isn't a BPE model that adds a space and leaves texts as they are")


def stretch_pattern(pieces: list[str]) -> re.Pattern:
    """Stretches begin at white space that follows another character, if no piece of B goes on into that kind of white space."""
    inside = {c for p in pieces for c in p[1:]}
    open_space = any(re.search(f"[^{_SPACE}]{_SPACE}", p) for p in pieces)
    begin = "".join(c for c in WHITE_SPACE if (not open_space if c == " " else c not in inside))
    other = "".join(c for c in WHITE_SPACE if c not in begin)
    going_on = f"(?:[{other}][{WHITE_SPACE}]*[^{WHITE_SPACE}]*)*" if other else ""
    return re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+{going_on}|[{WHITE_SPACE}]+")


def _engine(tokens: int):
    """An engine for one slice: one thread, no files, memory bounded by the slice's tokens."""
    import duckdb

    limit = 400 + 300 * max(0, tokens - _SLICE_TOKENS // 2) // 1_000_000
    return duckdb.connect(":memory:", config={"threads": 1, "memory_limit": f"{limit}MB", "temp_directory": ""})


_ENDS = """
CREATE TABLE ends AS
SELECT *, lag(i_a, 1, 0) OVER (ORDER BY e) AS before_a, lag(i_b, 1, 0) OVER (ORDER BY e) AS before_b
FROM (SELECT ta.e, ta.id AS a, tb.id AS b, ta.i AS i_a, tb.i AS i_b FROM ta JOIN tb ON ta.e = tb.e)
"""
_PAIRS = "CREATE TABLE pairs AS SELECT a, b, CAST(row_number() OVER (ORDER BY a, b) - 1 AS INTEGER) AS p FROM (SELECT DISTINCT a, b FROM ends)"
_LINKS = "CREATE TABLE links AS SELECT s.seg, p.p FROM ends x ASOF JOIN segs s ON x.e <= s.hi JOIN pairs p ON p.a = x.a AND p.b = x.b"
#: Where each token stands when a group's A tokens come before its B tokens, and whether it is the first of its group's A (1) or B (2).
_PLACES = """
SELECT t.i + x.before_b AS place, t.id, CASE WHEN t.i = x.before_a + 1 THEN 1 ELSE 0 END AS mark FROM ta t ASOF JOIN ends x ON t.e <= x.e
UNION ALL
SELECT t.i + x.i_a AS place, t.id, CASE WHEN t.i = x.before_b + 1 THEN 2 ELSE 0 END AS mark FROM tb t ASOF JOIN ends x ON t.e <= x.e
"""
_PAIR_SUMS = """
SELECT p.p, any_value(p.a) AS a, any_value(p.b) AS b, CAST(sum(t.n) AS BIGINT) AS held
FROM text_links t JOIN pairs p ON p.p = t.p GROUP BY p.p ORDER BY p.p
"""
_TEXT_LINKS = """
CREATE TABLE text_links AS
SELECT o.text, l.p, sum(o.times) AS n FROM occurrences o JOIN links l ON l.seg = o.seg GROUP BY o.text, l.p
"""


class Slice:
    """Texts (or parts of a long one) gathered until they are aligned together."""

    def __init__(self, pair: Pair, number: int):
        self.pair, self.number, self.chars, self.tokens = pair, number, 0, 0
        self.codes: defaultdict[str, int] = defaultdict(count().__next__)
        self.ids: list[bytes] = []
        self.without: set[int] = set()
        self.texts: list[tuple[int, int | None, np.ndarray, bool]] = []

    def add(self, row: int, doc_id: int | None, stretches: list[str], last: bool) -> bool:
        """Takes a text's stretches in; of one with a stretch without tokens, an empty text, and gives False."""
        known = len(self.codes)
        codes = np.fromiter(map(self.codes.__getitem__, stretches), np.int32, len(stretches))
        fresh = len(self.codes) - known
        if fresh:
            ids = self.pair.ids(list(islice(reversed(self.codes), fresh))[::-1])
            self.without |= {known + k for k, of in enumerate(ids) if of == _WITHOUT}
            self.ids += ids
            self.tokens += sum(map(len, ids)) // 4
        sound = not self.without or self.without.isdisjoint(codes.tolist())
        self.texts.append((row, doc_id, codes if sound else codes[:0], last))
        self.chars += sum(map(len, stretches))
        return sound

    def _tokens(self) -> tuple[pa.Table, pa.Table, np.ndarray, np.ndarray]:
        """Both sides' tokens, numbered, with their ends on the line of all stretches; each stretch's numbers of tokens."""
        flat, of = np.frombuffer(b"".join(self.ids), np.int32), np.fromiter(map(len, self.ids), np.int64, len(self.ids)) // 4
        n_a = flat[np.cumsum(of) - of].astype(np.int64) if len(of) else of
        n_b = of - 1 - n_a
        side = np.repeat(np.tile(np.array([2, 0, 1], np.int8), len(of)), np.stack([np.ones_like(n_a), n_a, n_b], axis=1).ravel())
        tables = []
        for k, sizes in enumerate((self.pair.a_sizes, self.pair.b_sizes)):
            ids = flat[side == k]
            tables.append(pa.table({"i": np.arange(1, len(ids) + 1), "id": ids, "e": np.cumsum(np.array(sizes, np.int64)[ids])}))
        return *tables, n_a, n_b

    def align(self) -> tuple[list[str], np.ndarray, list[tuple[np.ndarray, np.ndarray]], pa.Table]:
        """Each stretch's groups as text, each with a `;` before it; the stretches' numbers of A and B tokens and of groups; each text's links
        (pairs, times); and the sums of the pairs."""
        ta, tb, n_a, n_b = self._tokens()
        con = _engine(len(ta) + len(tb))
        ends = np.concatenate([[0], ta["e"].to_numpy()])[np.cumsum(n_a)]
        with_tokens = np.flatnonzero(n_a)
        segs = pa.table({"seg": with_tokens.astype(np.int32), "hi": ends[with_tokens]})
        each = [np.unique(codes, return_counts=True) for _, _, codes, _ in self.texts]
        occurrences = pa.table(
            {
                "text": np.repeat(np.arange(len(each), dtype=np.int32), [len(c) for c, _ in each]),
                "seg": np.concatenate([np.zeros(0, np.int32), *[c for c, _ in each]]),
                "times": np.concatenate([np.zeros(0, np.int64), *[n for _, n in each]]),
            }
        )
        for name, rows in (("ta", ta), ("tb", tb), ("segs", segs), ("occurrences", occurrences)):
            con.register(name, rows)
        for step in (_ENDS, _PAIRS, _LINKS, _TEXT_LINKS):
            con.execute(step)
        placed = con.execute(_PLACES).fetchnumpy()
        n_groups = con.execute("SELECT seg, count(*) AS n FROM links GROUP BY seg").fetchnumpy()
        found = con.execute("SELECT text, p, CAST(n AS INTEGER) AS n FROM text_links ORDER BY text, p").fetchnumpy()
        sums = con.sql(_PAIR_SUMS).to_arrow_table()
        con.close()

        counts = np.stack([n_a, n_b, np.zeros_like(n_a)])
        counts[2, n_groups["seg"]] = n_groups["n"]
        at = np.searchsorted(found["text"], np.arange(len(each) + 1))
        links = [(found["p"][at[k] : at[k + 1]].astype("<i4"), found["n"][at[k] : at[k + 1]].astype("<i4")) for k in range(len(each))]
        return self._told(placed, n_a + n_b), counts, links, sums

    def _told(self, placed: dict[str, np.ndarray], tokens: np.ndarray) -> list[str]:
        """The groups of each stretch, cut out of the text of all tokens in their places, each with its mark before it."""
        which = np.zeros(len(placed["place"]), np.int32)
        which[placed["place"] - 1] = placed["mark"].astype(np.int32) * self.pair.told_size + placed["id"]
        texts = self.pair.told.take(pa.array(which))
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[: len(which) + 1]
        edges = offsets[np.concatenate([[0], np.cumsum(tokens)])].tolist()
        whole = texts.buffers()[2].to_pybytes().decode() if len(which) else ""
        return [whole[lo:hi] for lo, hi in zip(edges, edges[1:], strict=False)]


class _Told:
    """The groups of a text as they come, kept as text or only as a digest."""

    def __init__(self, as_digest: bool):
        self.digest, self.parts, self.begun = hashlib.sha256() if as_digest else None, [], False

    def add(self, text: str) -> None:
        """text begins with the mark between groups, which the first group of all goes without."""
        told = text if self.begun else text[1:]
        self.begun = True
        if self.digest is None:
            self.parts.append(told)
        else:
            self.digest.update(told.encode())

    def value(self) -> str:
        return self.digest.hexdigest() if self.digest is not None else "".join(self.parts)


def _slice_rows(part: Slice, told: dict[int, _Told]) -> pa.RecordBatch:
    """The rows of a slice's texts, and one with the slice's pairs."""
    texts, counts, links, sums = part.align()
    rows = []
    for (row, doc_id, codes, last), (pairs, times) in zip(part.texts, links, strict=True):
        if len(codes):
            told[row].add("".join([texts[c] for c in codes.tolist()]))
        n_a, n_b, n_groups = (int(x) for x in counts[:, codes].sum(axis=1))
        groups = told.pop(row).value() if last and row in told else None
        rows.append((part.number, row, doc_id, n_a, n_b, n_groups, int(times.sum()), groups, pairs.tobytes(), times.tobytes(), None, None, None))
    pairs = [sums[c].to_pylist() for c in ("a", "b", "held")]
    rows.append((part.number, None, None, *[None] * len(_COUNTS), None, None, None, *pairs))
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), _ROW, strict=True)], schema=_ROW)


def _pieces(pair: Pair, text: str) -> Iterator[tuple[list[str], bool]]:
    """(stretches, whether they are the text's last); one without stretches for a text that has none, or is long and has no tokens."""
    held: list[str] = []
    if len(text) < _LONG or all(_WITHOUT not in pair.ids(list(dict.fromkeys(x))) for x in pair.stretches(text)):
        for stretches in pair.stretches(text) if text else ():
            if held:
                yield held, False
            held = stretches
    yield held, True


def _align_batches(batches: Iterator[pa.RecordBatch], pair: Pair, as_digest: bool, slice_chars: int) -> Iterator[pa.RecordBatch]:
    base, told = TaskContext.get().partitionId() << 33, {}
    part, row = Slice(pair, base), base
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for stretches, last in _pieces(pair, text.as_py() or ""):
                if part.add(row, doc_id, stretches, last) and stretches:
                    told.setdefault(row, _Told(as_digest))
                if part.chars > slice_chars or part.tokens > _SLICE_TOKENS or len(part.texts) > _SLICE_TEXTS:
                    yield _slice_rows(part, told)
                    part = Slice(pair, part.number + 1)
                    give_back()
            row += 1
    if part.texts:
        yield _slice_rows(part, told)


#: This worker's tokenizers, kept from task to task.
_PAIRS_OF_FILES: dict[tuple[str, str], Pair] = {}


def _worker_pair(path_a: str, path_b: str) -> Pair:
    if (path_a, path_b) not in _PAIRS_OF_FILES:
        _PAIRS_OF_FILES[path_a, path_b] = Pair(path_a, path_b)
    return _PAIRS_OF_FILES[path_a, path_b]


def _sum_links(texts: pa.Table, pairs: pa.Table) -> pa.Table:
    """The links of a slice's texts, summed over the counts of the slice's pairs."""
    n = 1 + max(pairs["p"].to_pylist(), default=-1)
    counts, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
    counts[pairs["p"].to_numpy()] = pairs["count"].to_numpy()
    best[pairs["p"].to_numpy()] = pairs["best"].to_numpy()
    n_best, sums = [], []
    for p, times in zip(texts["link_pairs"].to_pylist(), texts["link_counts"].to_pylist(), strict=True):
        of, often = np.frombuffer(p, "<i4"), np.frombuffer(times, "<i4").astype(np.int64)
        n_best.append(int((best[of] * often).sum()))
        sums.append(int((counts[of] * often).sum()))
    kept = texts.select(["row", "doc_id", *_COUNTS, "groups"])
    return kept.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))


def align(docs: DataFrame, path_a: str, path_b: str, as_digest: bool = False, slice_chars: int = _SLICE_CHARS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every document.

    groups is `a1,a2|b1;a3|b2,b3`: the ids of A and B group by group, null without tokens; or, as_digest, its SHA-256.
    """
    byte_ranks(path_a)
    check_model(path_b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _align_batches(batches, _worker_pair(path_a, path_b), as_digest, slice_chars)

    rows = written(map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, _ROW_DDL), "aligned")
    texts = rows.filter("row IS NOT NULL").drop("a", "b", "held")
    held = rows.filter("row IS NULL").select("slice", F.posexplode(F.arrays_zip("a", "b", "held")).alias("p", "pair"))
    held = held.select("slice", "p", F.col("pair.a").alias("a"), F.col("pair.b").alias("b"), F.col("pair.held").alias("held"))
    counts = written(held.groupBy("a", "b").agg(F.sum("held").alias("count")), "pair-counts")
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))
    judged = counts.join(highest, "b").select("a", "b", "count", (F.col("count") == F.col("highest")).cast("long").alias("best"))
    of_slices = held.join(judged, ["a", "b"]).select(F.col("slice").alias("of_slice"), "p", "count", "best")
    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, n_best long, count_sum long"
    summed = texts.groupBy("slice").cogroup(of_slices.groupBy("of_slice")).applyInArrow(_sum_links, schema)
    whole = summed.groupBy("row").agg(*[F.max("doc_id").alias("doc_id")], *[F.sum(c).alias(c) for c in (*_COUNTS, "n_best", "count_sum")], F.max("groups").alias("groups"))
    return whole.select("doc_id", *_COUNTS, "n_best", "count_sum", "groups")
