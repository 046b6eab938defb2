import hashlib
import json
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ledgerloom.llm import alignment, bpe, registry

from .conftest import SCHEMA

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def ends(tokens):
    out, at = [], 0
    for t in tokens:
        at += len(t)
        out.append(at)
    return out


def brute(rows, libraries):
    """(doc_id, groups text, n_a, n_b, n_groups, n_links, n_best, count_sum) of each (doc_id, text), from the whole texts."""
    a, b = libraries
    to_byte = {c: k for k, c in enumerate(bpe.byte_characters())}
    told = []
    for doc_id, text in rows:
        if not text:
            told.append((doc_id, None, [], [], []))
            continue
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(to_byte[c] for c in a.id_to_token(i)) for i in ids_a]
        pieces = [b.id_to_piece(i) for i in ids_b]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, pieces, strict=True)]
        spaced = (" " + text).encode()
        if b"".join(bytes_a) != spaced or b"".join(bytes_b) != spaced:
            told.append((doc_id, None, [], [], []))
            continue
        at_a, at_b = dict(zip(ends(bytes_a), ids_a, strict=True)), dict(zip(ends(bytes_b), ids_b, strict=True))
        links = [(at_a[e], at_b[e]) for e in at_a if e in at_b]
        groups, before = [], 0
        for e in (e for e in at_a if e in at_b):
            groups.append("|".join(",".join(str(i) for x, i in at.items() if before < x <= e) for at in (at_a, at_b)) if len(spaced) < 3000 else None)
            before = e
        told.append((doc_id, ";".join(groups) if None not in groups else "long", ids_a, ids_b, links))
    counts = Counter(link for *_, links in told for link in links)
    highest = Counter()
    for (_, of_b), n in counts.items():
        highest[of_b] = max(highest[of_b], n)
    return [
        (d, g, len(x), len(y), len(links), len(links), sum(counts[k] == highest[k[1]] for k in links), sum(counts[k] for k in links))
        for d, g, x, y, links in told
    ]


def check(docs, libraries, **options):
    rows = alignment.align(docs, A, B, **options).collect()
    expected = brute([(d.doc_id, d.text) for d in docs.collect()], libraries)
    groups = {e[1] for e in expected}
    found = [(r.doc_id, r.groups if r.groups in groups else "long", r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) for r in rows]
    assert sorted(found, key=str) == sorted(expected, key=str)


def test_whole_table(spark, libraries):
    sf = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in registry.op13_alignment(spark, sf).collect()}
    expected = brute([(d.doc_id, d.text) for d in spark.read.parquet(f"{sf}/documents.parquet").collect()], libraries)
    assert len(rows) == len(expected)
    for doc_id, groups, *numbers in expected:
        r = rows[doc_id]
        assert [r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum] == numbers
        assert groups == "long" or r.groups_sha256 == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")


def test_odd_rows(spark, libraries, odd_docs, clashing, no_docs):
    check(odd_docs, libraries)
    check(clashing, libraries)
    assert alignment.align(no_docs, A, B).count() == 0


TEXTS = [
    "<|endoftext|> a <s>b</s> <unk> <0x41>",
    "it's  \n\n 12,5 ½ don't\tx\r\n y\r z \r",
    " lead  and trail  ",
    " ",
    "  ",
    "\n",
    "\nword\n",
    "a\x00b \x1cx\x1d y",
    "takes the ▁ sign",
    "漢字かな 👩‍👩‍👧 q́   x　y\x85z",
    "(a);\r\n  }\r\n\r\n\t\tif (x) {\r return;\r}",
    "it's  \n\n 12,5 ½ don't\tx\r\n y\r z \r",
    "word " * 50,
]


def test_odd_texts_in_one_slice_and_in_many(spark, libraries):
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(TEXTS)], SCHEMA)
    check(docs, libraries)
    check(docs, libraries, slice_chars=20)


def test_a_long_text_goes_through_several_slices(spark, libraries):
    docs = spark.createDataFrame([(1, "ab c1, Straße\n\n  x" * 80_000, None, None, None), (2, "other words", None, None, None)], SCHEMA)
    assert len(docs.first().text) > alignment._LONG
    check(docs, libraries, slice_chars=50_000)
    digests = {r.groups for r in alignment.align(docs, A, B, as_digest=True, slice_chars=50_000).collect()}
    assert digests == {hashlib.sha256(r.groups.encode()).hexdigest() for r in alignment.align(docs, A, B).collect()}


def test_dense_texts_and_a_very_long_stretch(spark, libraries):
    """Texts of two characters a token, which fill a slice with tokens before its length does, and one stretch of 2.4 million letters."""
    rng = random.Random(6)
    texts = ["".join(rng.choices("abcdefgh", k=2_400_000)), *[" ".join("".join(rng.choices("qxzjkvw", k=9)) for _ in range(20_000)) for _ in range(10)]]
    check(spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA).coalesce(1), libraries)


def test_stretches_put_together_are_the_whole_text(libraries):
    """Every kind of white space in every neighbourhood, cut against whole."""
    pair = alignment.Pair(A, B)
    for space in bpe.WHITE_SPACE:
        for text in (f"a{space}b", f"{space}b", f"a{space}", f"a{space}{space} b", f"a {space}b", f");{space}{space}}}{space}x", f"{space}  ▂{space}\n\n{space}"):
            parts = [s for x in pair.stretches(text) for s in x]
            assert "".join(parts) == " " + text
            assert [i for s in parts for i in pair.encode_a(s)] == libraries[0].encode(" " + text, add_special_tokens=False).ids
            assert [i for ids in pair.encode_b(parts) for i in ids] == libraries[1].encode(text)


def test_a_by_the_quick_library_is_a(libraries):
    """Characters of all planes, and random neighbours."""
    pair, rng = alignment.Pair(A, B), random.Random(4)
    code_points = [c for c in range(0x3000) if not 0xD800 <= c < 0xE000] + list(range(0xA000, 0xB000)) + list(range(0x10000, 0x12000)) + list(range(0x1E000, 0x1F000))
    tokens = [libraries[0].decode([i]) for i in range(50_000)]
    texts = [t for c in code_points for t in (f" a{chr(c)}b", f" {chr(c)}! {chr(c)}")] + ["".join(rng.choices(tokens, k=5)) for _ in range(20_000)]
    expected = [e.ids for e in libraries[0].encode_batch(texts, add_special_tokens=False)]
    assert [pair.encode_a(t) for t in texts] == expected


def test_other_kinds_of_files(tmp_path):
    with pytest.raises(ValueError):
        alignment.byte_ranks(public_tokenizers.path("word_bpe_49k.json"))
    with open(A, encoding="utf-8") as f:
        told = json.load(f)
    told["model"]["merges"] = told["model"]["merges"][::-1]
    (tmp_path / "other.json").write_text(json.dumps(told), encoding="utf-8")
    with pytest.raises(ValueError):
        alignment.byte_ranks(str(tmp_path / "other.json"))
