import collections
import hashlib
import random
import string

from ledgerloom.llm import line_dedup

from .conftest import SCHEMA

WHITE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows, least=10):
    """(doc_id, n_lines, n_dropped, kept text) for rows (doc_id, text)."""
    holders = collections.defaultdict(set)
    order = lambda i: float("inf") if i is None else i
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[line.strip(WHITE).translate(LOWER)].add(order(i))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(k := x.strip(WHITE).translate(LOWER)) < least or min(holders[k]) == order(i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(df).collect()), key=str)


def test_odd_rows(odd_docs, clashing, no_docs):
    expected = brute([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert result(odd_docs) == expected
    assert result(clashing) == expected
    assert result(no_docs) == []


def test_random_lines_against_brute_force(spark):
    rng = random.Random(5)
    pool = ["".join(rng.choices("abÀÉß \tXYZ", k=rng.randint(0, 16))) for _ in range(60)] + ["a very common line"]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(0, 12))) if i % 17 else None, None, None, None) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert result(df) == brute([(r[0], r[1]) for r in rows])


def test_query_hashes_what_is_kept(spark):
    from ledgerloom.llm import registry

    got = {r.doc_id: r for r in registry.op8_line_dedup(spark, "/root/testdata/sf0.001").collect()}
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for i, n, dropped, text in brute(rows):
        assert (got[i].n_lines, got[i].n_dropped, got[i].kept_sha256) == (n, dropped, hashlib.sha256(text.encode()).hexdigest())
