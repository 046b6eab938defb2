"""Token counts by a map-side two-tier lookup of pre-token lengths.

Tier one is a table of frequent pre-tokens, broadcast as one block of text and one byte per length. It holds the tokenizer's own
vocabulary, which is what byte-pair training found frequent; its size is that of the vocabulary, whatever the corpus. Tier two is a
cache in each Python worker: a pre-token missing from tier one is merged once by the tokenizer's model and kept (at most
cache_entries, in two halves: when the newer is full the older goes, so what is met often stays). ASCII texts are cut by an equal
pattern of the standard library, which takes less than half the time. Pre-tokens never leave the task that cut them, so nothing is shuffled.

Defined results: null text counts as empty (0 bytes, 0 tokens); strings of special tokens inside a text count as one token, as the
library does by default; rows that repeat a doc_id each get a row; very long texts count whole, their pre-tokens in bounded lists; an
empty table gives no rows; extra columns, whatever their names, are ignored. A file that cuts texts in another way is an error.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.workers import map_batches

#: The pre-token pattern of the byte-level BPE files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same on ASCII texts; white space there is what \s of PATTERN takes.
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"
_LONGEST_CACHED, _LONG = 64, 1 << 20


def _byte_letters() -> dict[int, str]:
    """The characters by which a byte-level file writes bytes: visible Latin-1 ones stand for themselves, the others follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in plain)}


class LengthTable:
    """Lengths in tokens of pre-tokens: the broadcast tier, then this worker's cache, then the tokenizer."""

    def __init__(self, model_path: str, names: str, lengths: bytes, cache_entries: int):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(model_path)
        self.merge, self.letters = self.tokenizer.model.tokenize, _byte_letters()
        self.frequent = dict(zip(names.split("\x00"), lengths, strict=True)) if names else {}
        self.cache: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.cache_entries = cache_entries
        self.pattern, self.ascii_pattern = regex.compile(PATTERN), re.compile(ASCII_PATTERN)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None

    def _length(self, word: str) -> int:
        known = self.older.get(word)
        return len(self.merge(word.encode().decode("latin-1").translate(self.letters))) if known is None else known

    def _encode_missing(self, missing: set[str]) -> dict[str, int]:
        found = {w: self._length(w) for w in missing}
        if len(self.cache) + len(found) > self.cache_entries // 2:
            self.older, self.cache = self.cache, {}
        self.cache.update((p, n) for p, n in found.items() if len(p) <= _LONGEST_CACHED)
        return found

    def count(self, text: str) -> int:
        parts, n = [text], 0
        if self.special is not None and self.special.search(text):
            parts = self.special.split(text)
            n = len(parts) - 1
        return n + sum(self._count_words(words) for part in parts for words in self._cut(part))

    def _cut(self, part: str) -> Iterator[list[str]]:
        """The pre-tokens of a text; those of a very long one in lists of bounded length."""
        pattern = self.ascii_pattern if part.isascii() else self.pattern
        if len(part) <= _LONG:
            yield pattern.findall(part)
            return
        found = (m[0] for m in pattern.finditer(part))
        while words := list(islice(found, _LONG // 8)):
            yield words

    def _count_words(self, words: list[str]) -> int:
        lengths = list(map(self.frequent.get, words))
        if None not in lengths:
            return sum(lengths)
        n = sum(k for k in lengths if k is not None)
        rest = [w for w, k in zip(words, lengths, strict=True) if k is None]
        lengths = list(map(self.cache.get, rest))
        if None in lengths:
            found = self._encode_missing({w for w, k in zip(rest, lengths, strict=True) if k is None})
            lengths = [found[w] if k is None else k for w, k in zip(rest, lengths, strict=True)]
        return n + sum(lengths)


#: This worker's table, kept from task to task.
_TABLES: dict[tuple, LengthTable] = {}


def worker_table(model_path: str, shared, cache_entries: int) -> LengthTable:
    key = (model_path, cache_entries)
    if key not in _TABLES:
        _TABLES[key] = LengthTable(model_path, *shared.value, cache_entries)
    return _TABLES[key]


def check_file(model_path: str) -> None:
    """Raises where the file cuts texts in another way than by PATTERN, or rewrites them before."""
    with open(model_path, encoding="utf-8") as f:
        told = json.load(f)
    cut = told.get("pre_tokenizer") or {}
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
    if not plain or told.get("normalizer") is not None or told.get("truncation") is not None:
        raise ValueError(f"{model_path} isn't a byte-level BPE file with the usual pre-tokens and without a normalizer")


def frequent_lengths(model_path: str) -> tuple[str, bytes]:
    """The vocabulary's entries that are whole pre-tokens, and their lengths in tokens."""
    import regex
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(model_path)
    cut = regex.compile(PATTERN).findall
    added = set(tokenizer.get_added_tokens_decoder())
    words = [tokenizer.decode([i], skip_special_tokens=False) for i in range(tokenizer.get_vocab_size()) if i not in added]
    whole = sorted({w for w in words if w and "�" not in w and "\x00" not in w and cut(w) == [w]})
    lengths = [len(e) for e in tokenizer.encode_batch_fast(whole, add_special_tokens=False)]
    keep = [(w, n) for w, n in zip(whole, lengths, strict=True) if n < 256]
    return "\x00".join(w for w, _ in keep), bytes(n for _, n in keep)


def count_tokens(docs: DataFrame, model_path: str, cache_entries: int = 1_000_000) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every document under a byte-level BPE file of the tokenizers library."""
    check_file(model_path)
    shared = docs.sparkSession.sparkContext.broadcast(frequent_lengths(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = worker_table(model_path, shared, cache_entries)
        for batch in batches:
            counts = np.array([table.count(t.as_py()) if t.is_valid else 0 for t in batch.column(2)], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts)], ["doc_id", "n_bytes", "n_tokens"])

    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), n_bytes, "text")
    return map_batches(rows, run, "doc_id long, n_bytes long, n_tokens long")
