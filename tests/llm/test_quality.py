import tracemalloc
import zlib

import numpy as np
import pyarrow as pa

from ledgerloom.llm import quality, registry

SF = "/root/testdata/sf0.1"


def auc(scores, labels):
    order = np.argsort(np.argsort(scores, kind="stable"), kind="stable") + 1
    good = np.array(labels) == 1
    n, m = good.sum(), (~good).sum()
    return (order[good].sum() - n * (n + 1) / 2) / (n * m)


def test_held_out_accuracy(spark):
    rows = registry.op2_quality(spark, SF).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    unseen = [r for r in rows if r.held_out and r.doc_id in labels]
    truth = [labels[r.doc_id] for r in unseen]
    assert len(unseen) > 1000
    assert auc([r.score for r in unseen], truth) > 0.9
    assert np.mean([r.predicted == t for r, t in zip(unseen, truth, strict=True)]) > 0.85


def test_labels_of_held_out_rows_do_not_matter(spark):
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    stats = quality.document_statistics(docs)
    turned = labels.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.allclose(quality.train(stats, labels).means, quality.train(stats, turned).means)


def test_scores_match_the_densities(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    statistics = quality.document_statistics(docs)
    model = quality.train(statistics, labels)
    stats = {r.doc_id: np.array(r.x) for r in statistics.collect()}
    for r in quality.score(statistics, model).collect():
        x = (stats[r.doc_id] - model.shift) / model.scale
        logs = []
        for mean, factor in zip(model.means, model.factors, strict=True):
            cov = factor @ factor.T
            d = x - mean
            logs.append(-0.5 * d @ np.linalg.inv(cov) @ d - 0.5 * np.linalg.slogdet(cov)[1])
        assert abs(r.score - 1 / (1 + np.exp(-(logs[1] - logs[0] + model.prior) / model.temperature))) < 1e-6


def test_odd_rows(spark, odd_docs, clashing, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 0, 0), (4, None, 0), (5, 0, 0), (6, 0, 1), (7, 1, 0), (8, 2, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")
    of = quality.document_statistics
    model = quality.train(of(odd_docs), labels)
    got = sorted(map(str, quality.score(of(odd_docs), model).collect()))
    assert len(got) == odd_docs.count()
    assert got == sorted(map(str, quality.score(of(clashing), model).collect()))
    assert quality.score(of(no_docs), model).count() == 0
    assert quality.keep_good(clashing, model).columns == clashing.columns
    unseen = quality.train(of(odd_docs), labels.filter("quality = 1"))
    assert len({r.score for r in quality.score(of(odd_docs), unseen).collect()}) == 1
    assert {r.score for r in quality.score(of(odd_docs), quality.train(of(no_docs), labels.limit(0))).collect()} == {0.5}
    assert quality.train_and_score(clashing, labels).count() == clashing.count()


def test_memory_of_a_very_long_text():
    """What counting takes beside the text itself, for texts with short words and with long ones."""
    rng = np.random.default_rng(1)
    for word in (5, 11):
        letters = rng.integers(97, 123, (3_000_000, word), dtype=np.uint8)
        letters[:, -1] = 32
        text = pa.array([letters.tobytes().decode()])
        tracemalloc.start()
        found = quality._statistics(text)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert found.shape == (1, quality.N_STATISTICS) and peak < 5 * letters.size + (64 << 20)
