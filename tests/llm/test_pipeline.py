from collections import Counter

import corpus_pipeline
from ledgerloom.llm import quality, registry

from . import test_decontamination, test_mixing, test_near_dedup

SF = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages, at = dict(corpus_pipeline.STAGES), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "sharding":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        at[name] = (docs, docs := spark.read.parquet(f"{tmp_path}/{name}"))
    assert list(stages) == ["quality", "near_dedup", "decontamination", "mixing", "sharding"]

    before, after = at["quality"]
    good = {r.doc_id for r in registry.op2_quality(spark, SF).collect() if r.predicted}
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in before.collect() if r.doc_id in good)

    before, after = at["near_dedup"]
    classes = test_near_dedup.classes([(r.doc_id, r.text) for r in before.collect()])
    kept = after.collect()
    assert sorted(classes[r.doc_id] for r in kept) == sorted(set(classes.values()))

    before, after = at["decontamination"]
    items = [(str(b.item_id), b.text) for b in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {r[1] for r in test_decontamination.brute([(r.doc_id, r.text) for r in before.collect()], items) if r[5]}
    assert sorted(map(str, after.collect())) == sorted(str(r) for r in before.collect() if r.doc_id not in bad)

    before, after = at["mixing"]
    size = lambda t: len((t or "").split())
    sizes, mixed = Counter(), Counter()
    for r in before.collect():
        sizes[r.source] += size(r.text)
    for r in after.collect():
        mixed[r.source] += size(r.text)
    for source, target in test_mixing.water_fill(dict(sizes)).items():
        assert abs(mixed[source] - target) <= 0.05 * target + 64

    before, after = at["sharding"]
    assert sorted(str(r.doc_id) for r in before.collect()) == sorted(str(r.doc_id) for r in after.collect())
    for shard in range(24):
        slots = sorted(r.slot for r in after.filter(f"shard = {shard}").collect())
        assert slots == list(range(len(slots)))


def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == [*spark.read.parquet(f"{SF}/documents.parquet").columns, "shard", "slot"] and rows.count() > 0


def test_stages_take_empty_and_odd_rows(spark, odd_docs, clashing, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (5, 0), (7, 1)], "doc_id long, quality int")
    model = quality.train(quality.document_statistics(odd_docs), labels)
    assert quality.keep_good(no_docs, model).count() == 0
    for rows in (no_docs, odd_docs, clashing):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, rows, SF)
            found = [r.doc_id for r in got.collect()]
            assert set(got.columns) >= set(docs_columns(rows)), name
            assert set(found) <= {r.doc_id for r in rows.collect()} and (found or rows is no_docs or name == "quality"), name
            if name == "sharding":
                assert sorted(map(str, found)) == sorted(str(r.doc_id) for r in rows.collect())


def docs_columns(rows):
    return [c for c in rows.columns if c not in ("shard", "slot")]


def test_run_leaves_only_what_its_result_reads(spark):
    from ledgerloom.llm import scratch

    start = scratch.mark()
    corpus_pipeline.run(spark, SF).count()
    left = [f.rsplit("/", 1)[1].rsplit("-", 1)[0] for f in scratch._MADE[start:]]
    assert left[0] == "stage-mixing" and not {"signatures", "elements", "stage-quality"} & set(left)
