import re

import numpy as np
import pyarrow as pa

from ledgerloom.llm import decontamination, registry

from .conftest import SCHEMA

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def brute(docs, items, size=13):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append((doc_id is None, doc_id, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def told(overlaps):
    rows = decontamination.judge(overlaps).collect()
    return sorted((r.doc_id is None, r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in rows)


ITEMS = [("b", "The quick brown fox"), ("a", "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"), ("c", ""), ("d", None), ("e", "naß"), ("f", "the quick brown fox")]
TEXTS = ["so one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen", "The QUICK, brown fox. The quick brown fox the quick brown", "fourteen fifteen one two", "quick brown fox", "ist naß; naß", "one two three four five six seven eight nine ten eleven twelve thirteen " * 3]


def test_small_cases(spark, odd_docs, clashing, no_docs):
    benchmark = spark.createDataFrame(ITEMS, "item_id string, text string")
    docs = odd_docs.unionByName(spark.createDataFrame([(200 + i, t, None, None, None) for i, t in enumerate(TEXTS)], SCHEMA))
    expected = brute([(d.doc_id, d.text) for d in docs.collect()], ITEMS)
    assert told(decontamination.find_overlaps(docs, benchmark)) == expected
    assert told(decontamination.find_overlaps(docs, benchmark, shard_bytes=30)) == expected
    assert told(decontamination.find_overlaps(docs, benchmark, block_bytes=60)) == expected
    assert told(decontamination.find_overlaps(clashing, benchmark)) == told(decontamination.find_overlaps(odd_docs, benchmark))
    assert decontamination.find_overlaps(no_docs, benchmark).count() == 0
    assert all(r[3] == 0 for r in told(decontamination.find_overlaps(docs, benchmark.limit(0))))
    bad = {r[1] for r in expected if r[5]}
    for blocks in (60, 1 << 20):
        kept = decontamination.drop_contaminated(docs, benchmark, block_bytes=blocks)
        assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d.doc_id) for d in docs.collect() if d.doc_id not in bad)


def test_whole_table_by_shard_size(spark):
    sf = "/root/testdata/sf0.001"
    docs, benchmark = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    expected = brute([(d.doc_id, d.text) for d in docs.collect()], [(str(b.item_id), b.text) for b in benchmark.collect()])
    got = registry.op10_decontamination(spark, sf).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got) == [(r[1], r[2], r[3], len(r[4]), r[5]) for r in expected]
    assert any(r[5] for r in expected)


def test_fm_index_finds_every_place():
    rng = np.random.default_rng(0)
    for n in (1, 2, 30, 500):
        sequence = rng.integers(0, 4, n).astype(np.int32)
        sequence[-1] = 0
        index = decontamination.FMIndex(sequence, 4, sample=5)
        patterns = [p for k in (1, 2, 3) for p in {tuple(sequence[i : i + k]) for i in range(n - k + 1)} if 0 not in p]
        if not patterns:
            continue
        lengths = np.array([len(p) for p in patterns])
        table = np.zeros((len(patterns), 3), np.int32)
        for i, p in enumerate(patterns):
            table[i, : len(p)] = p
        which, low, high = index.search(table.ravel(), np.arange(len(patterns)) * 3 + lengths, lengths)
        found = {tuple(patterns[w]): sorted(index.locate(np.arange(a, b))) for w, a, b in zip(which, low, high, strict=True)}
        for p in patterns:
            assert found[p] == [i for i in range(n - len(p) + 1) if tuple(sequence[i : i + len(p)]) == p]


def test_windows_of_nothing():
    assert decontamination.Windows([], pa.array([], pa.large_string()), 13).shortest == 0


def test_pieces_of_a_long_stretch(monkeypatch):
    """A text that repeats the benchmark is one stretch; cut to small pieces it gives the same occurrences."""
    item = " ".join(f"w{i % 17}" for i in range(60))
    windows = decontamination.Windows(["a", "b"], pa.array([item, "w3 w4"], pa.large_string()), 13)
    cut = decontamination.cut_words(pa.array([item + " " + item + " x " + item, "w3 w4 " * 40]))
    whole = sorted(zip(*decontamination.occurrences(windows, cut.hashes, cut.rows()), strict=True))
    for piece in (1, 7, 50):
        monkeypatch.setattr(decontamination, "_PIECE", piece)
        assert sorted(zip(*decontamination.occurrences(windows, cut.hashes, cut.rows()), strict=True)) == whole
    assert len(whole) > 150


def test_windows_of_a_large_benchmark_are_compact():
    rng = np.random.default_rng(0)
    texts = [" ".join(f"word{k}" for k in rng.integers(0, 50_000, 250)) for _ in range(2_000)]
    texts += texts[:500]
    windows = decontamination.Windows([str(i) for i in range(len(texts))], pa.array(texts, pa.large_string()), 13)
    held = sum(v.nbytes for v in vars(windows).values() if isinstance(v, np.ndarray))
    assert held < 8 * sum(map(len, texts)) + (2 << 20)
    assert len(windows.lengths) == 2_000 * 238 and len(windows.holders) == 2_500 * 238
