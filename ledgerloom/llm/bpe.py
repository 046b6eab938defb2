"""BPE encoding by dynamic programming over prefixes, and decoding.

A text is cut into pre-tokens as the file says. Inside one, an automaton of the vocabulary (Aho-Corasick) reports the entries that end at
each position. Of these exactly one can be the last token of the prefix that ends there: the one whose neighbour to the left, itself the
last token of the shorter prefix, is compatible with it. Two tokens are compatible if the merges of their joined text, in order of rank and
then from left to right, never cross the seam. So each prefix keeps one token, and following the tokens' lengths back from the end gives the
very ids that the merges give, in time linear in the pre-token. Entries that the merges of their own text don't lead to never come out,
so the automaton leaves them out.

Compatibility is decided by undoing merges: of the two pieces at the seam, the one merged later is taken apart first, and the seam holds if
at no stage the pair of pieces there has a merge that comes before the one that takes either of them up.

White space ends pre-tokens and never takes part in normalization, so a stretch between white space is encoded by itself; a worker keeps
the ids of short stretches (at most cache_entries, then it starts anew). Stretches with characters younger than Unicode 3.2, on whose
classes Python and the library may differ, are normalized and cut by the library's own parts. Nothing is shuffled.

Defined results: null text counts as empty (no ids, decoded to an empty text); strings of special tokens inside a text become that token, as
the library does by default; rows that repeat a doc_id each get a row; very long texts are encoded whole, in pieces cut at white space; an
empty table gives no rows; extra columns, whatever their names, are ignored. A file of another build (other normalizer, pre-tokens, decoder
or post-processor) is an error.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.workers import map_batches

#: The parts of a word-end BPE file that this module follows.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
WORD_END = "</w>"
#: The pattern among ASCII characters in lower case.
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+"
#: The characters with Unicode's White_Space property.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

#: Characters that Python's split takes for white space and the files don't.
_NO_SPACE = "\x1c\x1d\x1e\x1f"

_NEVER, _BASE = 1 << 60, -1
_END = "\x00"
_LONGEST_CACHED, _PIECE = 64, 1 << 20


@cache
def byte_characters() -> str:
    """The character that stands for each byte in a byte-level vocabulary: itself where it prints in Latin-1, else the next from U+0100."""
    prints = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    spare = iter(range(0x100, 0x200))
    return "".join(chr(b if b in prints else next(spare)) for b in range(256))


class Settled:
    """Whether all characters of a text are of Unicode 3.2, whose classes no later version has changed in a way that matters here."""

    def __init__(self):
        self.known: set[str] = set()

    def __call__(self, text: str) -> bool:
        fresh = set(text) - self.known
        if any(unicodedata.ucd_3_2_0.category(c) == "Cn" for c in fresh):
            return False
        self.known |= fresh
        return True


class PrefixEncoder:
    """Exact BPE of one pre-token, by the last token of each of its prefixes."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], word_end: str):
        import ahocorasick

        self.parts: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        self.rank: dict[tuple[int, int], int] = {}
        ends = {i for token, i in vocabulary.items() if word_end and len(token) == 1 + len(word_end) and token.endswith(word_end)}
        for at, (a, b) in enumerate(merges):
            pair = (vocabulary[a], vocabulary[b])
            made = vocabulary[a + b]
            if made in self.born:
                raise ValueError(f"two merges make {a + b!r}")
            self.rank[pair], self.born[made], self.parts[made] = at, at, pair
            if pair[1] in ends:
                ends.add(made)
        self.known: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        self.length: dict[int, int] = {}
        lone = self.lone = {i for token, i in vocabulary.items() if i not in self.parts}
        for made, (left, right) in self.parts.items():
            if left in lone and right in lone and self._seam_holds(left, right, until_merged=True):
                lone.add(made)
        for token, i in vocabulary.items():
            if i not in lone:
                continue
            key = token[: -len(word_end)] + _END if i in ends else token
            self.length[i] = len(key)
            self.automaton.add_word(key, (i, len(key)))
        self.automaton.make_automaton()

    def _compatible(self, left: int, right: int) -> bool:
        """Whether no merge crosses the seam; kept, as the same pairs come again and again."""
        if len(self.known) > 300_000:
            self.known.clear()
        holds = self.known[left << 32 | right] = self._seam_holds(left, right)
        return holds

    def _seam_holds(self, left: int, right: int, until_merged: bool = False) -> bool:
        """Whether no merge crosses the seam, or, until_merged, none but that of the two whole tokens."""
        left_taken = right_taken = _NEVER
        while True:
            crossing = _NEVER if until_merged else self.rank.get((left, right), _NEVER)
            until_merged = False
            if crossing < left_taken and crossing <= right_taken and crossing < _NEVER:
                return False
            left_born, right_born = self.born.get(left, _BASE), self.born.get(right, _BASE)
            if left_born > right_born:
                left_taken, left = left_born, self.parts[left][1]
            elif right_born > _BASE:
                right_taken, right = right_born, self.parts[right][0]
            else:
                return True

    def encode(self, word: str) -> list[int]:
        """The ids of a pre-token of byte characters."""
        known = self.known
        last = [-1] * (len(word) + 1) if len(word) < _PIECE else array("i", [-1]) * (len(word) + 1)
        for end, (token, length) in self.automaton.iter(word + _END):
            if last[end] < 0:
                start = end - length
                if start >= 0:
                    left = last[start]
                    holds = known.get(left << 32 | token)
                    if not (self._compatible(left, token) if holds is None else holds):
                        continue
                last[end] = token
        ids, end = [], len(word)
        while end >= 0:
            ids.append(last[end])
            end -= self.length[last[end]]
        ids.reverse()
        return ids


class Encoder:
    """Texts to ids by one file, with this worker's cache of stretches."""

    def __init__(self, model_path: str, cache_entries: int):
        import regex
        from tokenizers import Tokenizer

        told = _read(model_path)
        self.library = Tokenizer.from_file(model_path)
        model = told["model"]
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.prefixes = PrefixEncoder(model["vocab"], merges, WORD_END)
        self.cut = regex.compile(PATTERN).findall
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.on_special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        self.bytes = {b: c for b, c in enumerate(byte_characters())}
        self.ascii_cut = re.compile(ASCII_PATTERN).findall
        self.stretch: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.cache_entries = cache_entries
        self.between = re.compile(f"[{WHITE_SPACE}]+")
        self.is_settled = Settled()

    def _cut(self, stretch: str) -> list[str]:
        """The pre-tokens of a stretch, as byte characters."""
        if stretch.isascii():
            plain = stretch.lower()
            if not plain.isprintable():
                return [w.translate(self.bytes) for w in self.cut(plain)]
            return [plain] if plain.isalpha() else self.ascii_cut(plain)
        if self.is_settled(stretch):
            plain = unicodedata.normalize("NFC", stretch).replace("Σ", "σ").lower()
            words = [plain] if plain.isalpha() else self.cut(plain)
            return [w.encode().decode("latin-1").translate(self.bytes) for w in words]
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(stretch))]

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            ids = array("i", self.prefixes.encode(word)).tobytes()
            if len(word) <= _LONGEST_CACHED:
                if len(self.words) >= self.cache_entries:
                    self.words.clear()
                self.words[word] = ids
        return ids

    def _missing(self, stretch: str) -> bytes:
        words = self._cut(stretch)
        ids = self._word(words[0]) if len(words) == 1 else b"".join(map(self._word, words))
        if len(stretch) <= _LONGEST_CACHED:
            if len(self.stretch) >= self.cache_entries:
                self.stretch.clear()
            self.stretch[stretch] = ids
        return ids

    def _stretches(self, text: str) -> Iterator[list[str]]:
        """What stands between white space; of a very long text in lists of bounded length."""
        at, plain = 0, not any(c in text for c in _NO_SPACE)
        while at < len(text):
            end = at + _PIECE
            if end < len(text):
                space = self.between.search(text, end)
                end = space.end() if space else len(text)
            part = text[at:end] if at or end < len(text) else text
            yield part.split() if plain else [s for s in self.between.split(part) if s]
            at = end

    def _plain(self, text: str) -> bytes:
        pieces = []
        for stretches in self._stretches(text):
            found = list(map(self.stretch.get, stretches))
            if None in found:
                found = [self._missing(s) if ids is None else ids for s, ids in zip(stretches, found, strict=True)]
            pieces.append(b"".join(found))
        return b"".join(pieces)

    def encode(self, text: str) -> bytes:
        """The ids of a text, as 32-bit integers."""
        if not any(s in text for s in self.special):
            return self._plain(text)
        parts = self.on_special.split(text)
        return b"".join(array("i", [self.special[p]]).tobytes() if k % 2 else self._plain(p) for k, p in enumerate(parts))


def _read(model_path: str) -> dict:
    """The file, if it is a byte-level BPE with word ends of the build this module follows."""
    with open(model_path, encoding="utf-8") as f:
        told = json.load(f)
    model, cut = told["model"], (told.get("pre_tokenizer") or {}).get("pretokenizers") or []
    steps = [n["type"] for n in (told.get("normalizer") or {}).get("normalizers") or []]
    same = (
        model.get("type", "BPE") == "BPE"
        and model.get("end_of_word_suffix") == WORD_END
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges", "unk_token"))
        and steps == NORMALIZERS
        and [c["type"] for c in cut] == ["Split", "ByteLevel"]
        and cut[0]["pattern"] == {"Regex": PATTERN}
        and not cut[1]["add_prefix_space"]
        and not any(told.get(k) for k in ("truncation", "padding", "post_processor", "decoder"))
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in told["added_tokens"])
    )
    if not same:
        raise ValueError(f"{model_path} isn't a byte-level BPE file with word ends of the known build")
    return told


#: This worker's encoders and token tables, kept from task to task.
_ENCODERS: dict[tuple[str, int], Encoder] = {}
_TOKENS: dict[str, pa.Array] = {}


def worker_encoder(model_path: str, cache_entries: int) -> Encoder:
    key = (model_path, cache_entries)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(model_path, cache_entries)
    return _ENCODERS[key]


def _worker_tokens(model_path: str) -> pa.Array:
    """The text of each id, null for ids that the file doesn't have."""
    if model_path not in _TOKENS:
        told = _read(model_path)
        names = {**{i: t for t, i in told["model"]["vocab"].items()}, **{t["id"]: t["content"] for t in told["added_tokens"]}}
        _TOKENS[model_path] = pa.array([names.get(i) for i in range(max(names) + 1)], pa.large_string())
    return _TOKENS[model_path]


def encode(docs: DataFrame, model_path: str, cache_entries: int = 250_000) -> DataFrame:
    """(doc_id, ids) of every document under a byte-level BPE file with word ends of the tokenizers library."""
    _read(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(model_path, cache_entries)
        for batch in batches:
            found = [encoder.encode(text.as_py()) if text.is_valid else b"" for text in batch.column(1)]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(ids) // 4 for ids in found])]).astype(np.int32))
            flat = pa.array(np.frombuffer(b"".join(found), np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "ids"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids, text): ids turned back to text as the library does without a decoder: tokens joined by a space, special ones included.

    Null ids give a null text, ids outside the file are passed over, as the library passes over them.
    """
    _read(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _worker_tokens(model_path)
        for batch in batches:
            ids = batch.column(1)
            known = pc.fill_null(pc.and_(pc.greater_equal(ids.flatten(), 0), pc.less(ids.flatten(), len(names))), False)
            found = names.take(pc.if_else(known, ids.flatten(), pa.scalar(None, pa.int32())))
            parents, valid = ids.value_parent_indices() if hasattr(ids, "value_parent_indices") else pc.list_parent_indices(ids), found.is_valid()
            counts = np.bincount(parents.filter(valid).to_numpy(zero_copy_only=False), minlength=len(ids))
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int64))
            joined = pc.binary_join(pa.LargeListArray.from_arrays(offsets, found.filter(valid)), pa.scalar(" ", pa.large_string()))
            text = pc.if_else(ids.is_valid(), joined, pa.scalar(None, pa.large_string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, text.cast(pa.string())], ["doc_id", "ids", "text"])

    return map_batches(tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "ids"), run, "doc_id long, ids array<int>, text string")
