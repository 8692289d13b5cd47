import corpus_pipeline
from driftloom.llm import language_id, queries

from .test_decontamination import brute as contaminated
from .test_ngram_join import brute as groups
from .test_secrets import brute as base_secrets


def test_stages_on_the_small_tables(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "ngram_join", "decontamination", "secrets", "packing"]

    kept = stages["language_id"](spark, docs, sf_dir)
    assert kept.columns == columns
    before = {r.doc_id: r.text for r in docs.collect()}
    after = {r.doc_id: r.text for r in kept.collect()}
    assert set(before) - set(after) <= {i for i, t in before.items() if not language_id.has_letter(t) or len(t) < 60}

    kept = stages["ngram_join"](spark, docs, sf_dir)
    assert kept.columns == columns
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    root = {d: c for d, _, c in groups(rows, 5, 80)}
    assert sorted(root[r.doc_id] for r in kept.collect()) == sorted(set(root.values()))

    kept = stages["decontamination"](spark, docs, sf_dir)
    assert kept.columns == columns
    assert {r.doc_id for r in kept.collect()} == {i for i, t in rows if not contaminated(t, bench)[1]}

    kept = stages["secrets"](spark, docs, sf_dir)
    assert kept.columns == columns and kept.count() == docs.count()
    for r in kept.collect():
        assert not base_secrets(r.text)
        if not base_secrets(before[r.doc_id]):
            assert r.text == before[r.doc_id]

    packed = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(packed.columns) and packed.count() > 0


def test_queries_are_registered():
    assert sorted(queries.QUERIES, key=lambda q: int(q[2:].split("_")[0])) == [f"op{n}_{q}" for n, q in enumerate(("sharding", "decontamination", "quality_rules", "quality_classifier", "license_scan", "ngram_join", "html_extraction", "packing", "language_id", "secrets", "lexical_search", "exact_dedup", "spelling_variants"), 1)]
