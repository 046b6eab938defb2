import json

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm import registry, token_counts

from .conftest import SCHEMA

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, docs):
    library = Tokenizer.from_file(PATH)
    expected = sorted(
        (d.doc_id is None, d.doc_id, len((d.text or "").encode()), len(library.encode(d.text or "", add_special_tokens=False))) for d in docs
    )
    assert sorted((r.doc_id is None, r.doc_id, r.n_bytes, r.n_tokens) for r in rows) == expected


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = registry.op3_token_counts(spark, sf).collect()
    check(rows, spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert all(r.over_limit == (r.n_tokens > 1024) for r in rows)


def test_odd_rows(spark, odd_docs, clashing, no_docs):
    check(token_counts.count_tokens(odd_docs, PATH).collect(), odd_docs.collect())
    check(token_counts.count_tokens(clashing, PATH).collect(), odd_docs.collect())
    assert token_counts.count_tokens(no_docs, PATH).count() == 0


def test_special_strings_and_a_small_cache(spark):
    texts = ["<|endoftext|>", "a<|endoftext|>b  c", "x <|endoftext|> <|endoftext|>", "it's  \n\n 12,5 ½ ²³ Ⅷ don't", "   a　b\x00\x01", "émigré naïve 漢字かな 👩‍👩‍👧 q́", "z" * 70 + " zz", " \t ", "'S 're 'LL"]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    check(token_counts.count_tokens(docs, PATH, cache_entries=3).collect(), docs.collect())


def test_a_very_long_text_and_another_kind_of_file(spark, tmp_path):
    docs = spark.createDataFrame([(1, "ab c1, Straße\n\n  x" * 120_000, None, None, None)], SCHEMA)
    assert len(docs.first().text) > 2 * token_counts._LONG
    check(token_counts.count_tokens(docs, PATH).collect(), docs.collect())
    with open(PATH, encoding="utf-8") as f:
        told = json.load(f)
    told["pre_tokenizer"] = {"type": "Whitespace"}
    (tmp_path / "other.json").write_text(json.dumps(told), encoding="utf-8")
    with pytest.raises(ValueError):
        token_counts.count_tokens(docs, str(tmp_path / "other.json"))


def test_words_met_again_are_merged_once():
    """Every word that the vocabulary lacks went through the whole tokenizer, and a full cache forgot all: 1302 CPU seconds a GB."""
    table = token_counts.LengthTable(PATH, *token_counts.frequent_lengths(PATH), 8)
    library, asked = Tokenizer.from_file(PATH), []
    merge = table.merge
    table.merge = lambda w: asked.append(w) or merge(w)
    for k in range(9):
        text = f" qzxvvyk jjwqqpf{k} ñandúes{k}\x1c\x1f \t x"
        assert table.count(text) == len(library.encode(text, add_special_tokens=False))
    assert asked.count("Ġqzxvvyk") == 1 and len(table.cache) + len(table.older) <= 16


def test_ascii_texts_are_cut_as_others():
    import random
    import re

    import regex

    draw = random.Random(3)
    letters = [chr(c) for c in range(128)] + list("  \n\t''sstrevmd09") * 4
    texts = ["".join(draw.choices(letters, k=60)) for _ in range(3000)]
    assert all(re.findall(token_counts.ASCII_PATTERN, t) == regex.findall(token_counts.PATTERN, t) for t in texts)
