import hashlib
import json
import random

import pytest
import public_tokenizers
from tokenizers import Tokenizer

from ledgerloom.llm import bpe, registry

from .conftest import SCHEMA

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def by_merges(symbols, rank):
    """The ids' texts by the definition: the merge of lowest rank, the leftmost of those, until none is left."""
    while True:
        found = min(((rank[pair], k) for k, pair in enumerate(zip(symbols, symbols[1:], strict=False)) if pair in rank), default=None)
        if found is None:
            return symbols
        k = found[1]
        symbols = [*symbols[:k], symbols[k] + symbols[k + 1], *symbols[k + 2 :]]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_random_merges_against_the_definition():
    rng = random.Random(5)
    for _ in range(30):
        letters = "abc"
        vocabulary = {c: k for k, c in enumerate(letters)} | {c + "</w>": k + 3 for k, c in enumerate(letters)}
        merges = []
        for _ in range(rng.randrange(1, 25)):
            a, b = rng.choice([t for t in vocabulary if not t.endswith("</w>")]), rng.choice(list(vocabulary))
            if a + b not in vocabulary:
                vocabulary[a + b] = len(vocabulary)
                merges.append((a, b))
        encoder, names = bpe.PrefixEncoder(vocabulary, merges, "</w>"), {i: t for t, i in vocabulary.items()}
        for _ in range(100):
            word = "".join(rng.choices(letters, k=rng.randrange(1, 14)))
            expected = by_merges([*word[:-1], word[-1] + "</w>"], {m: k for k, m in enumerate(merges)})
            assert [names[i] for i in encoder.encode(word)] == expected


def test_whole_table(spark, library):
    sf = "/root/testdata/sf0.01"
    rows = sorted(registry.op12_bpe(spark, sf).collect())
    expected = []
    for d in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        expected.append((d.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert [tuple(r) for r in rows] == sorted(expected)


def check(spark, library, docs, **options):
    tokens = bpe.encode(docs, PATH, **options)
    found = sorted((r.doc_id is None, r.doc_id, r.ids, r.text) for r in bpe.decode(tokens, PATH).collect())
    all_ids = [(d.doc_id, library.encode(d.text or "", add_special_tokens=False).ids) for d in docs.collect()]
    assert found == sorted((i is None, i, ids, library.decode(ids, skip_special_tokens=False)) for i, ids in all_ids)


def test_odd_rows(spark, library, odd_docs, clashing, no_docs):
    check(spark, library, odd_docs)
    check(spark, library, clashing)
    assert bpe.encode(no_docs, PATH).count() == 0 and bpe.decode(bpe.encode(no_docs, PATH), PATH).count() == 0


def test_odd_texts_and_a_small_cache(spark, library):
    texts = ["<|endoftext|>", "a<|startoftext|>B  c", "x <|endoftext|> <|endoftext|>É", "it's  \n\n 12,5 ½ ²³ Ⅷ don't", "a　b\x00\x01 \x1c\x1da\x1fb", "émigré q́ ΣΑΣ İI ß", "漢字かな 👩‍👩‍👧 Ა\U0001e030", "'S 're 'LL", "</w> a</w>"]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    check(spark, library, docs, cache_entries=3)


def test_characters_of_all_planes(spark, library):
    code_points = [c for c in range(0x3000) if not 0xD800 <= c < 0xE000] + list(range(0xA000, 0xB000)) + list(range(0x10000, 0x12000)) + list(range(0x1E000, 0x1F000))
    texts = [f"a{chr(c)}b {chr(c)}! e{chr(c)}́" for c in code_points]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    check(spark, library, docs)


def test_very_long_texts(spark, library):
    texts = ["ab c1, Straße\n\n  x" * 120_000, "a" * 300_000, "né" * 100_000]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    assert len(texts[0]) > 2 * bpe._PIECE
    check(spark, library, docs)


def test_decoding_passes_over_unknown_ids(spark, library):
    tokens = spark.createDataFrame([(1, [1, 999_999, None, 49407, -3]), (2, []), (3, None)], "doc_id long, ids array<int>")
    rows = {r.doc_id: r.text for r in bpe.decode(tokens, PATH).collect()}
    assert rows == {1: library.decode([1, 49407], skip_special_tokens=False), 2: "", 3: None}


def test_another_kind_of_file(tmp_path):
    with pytest.raises(ValueError):
        bpe._read(public_tokenizers.path("byte_bpe_50k.json"))
    with open(PATH, encoding="utf-8") as f:
        told = json.load(f)
    told["normalizer"] = None
    (tmp_path / "other.json").write_text(json.dumps(told), encoding="utf-8")
    with pytest.raises(ValueError):
        bpe._read(str(tmp_path / "other.json"))
