"""The pipeline's stages one after the other against plain decisions, and whole on the smallest tables."""

import os

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from quillmart.llm.common import materialize  # noqa: E402

from .test_operators import five_word_groups, norm, plain_hits  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, docs, rows, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    docs.write.parquet(str(path / "documents.parquet"))
    labels = [(i, 0 if t and "***" in t else 1, 0) for i, t, *_ in rows if i is not None and i < 120]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(rows[30][1].split()[:20])), (2, None)], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


def test_stages_decide_as_plain_code_does(spark, folder, rows):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "exact_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns

    def after(name):
        nonlocal docs
        docs = materialize(stages[name](spark, docs, folder))
        if name != "best_fit_packing":
            assert docs.columns == columns
        return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()] if "text" in docs.columns else docs.collect()

    kept = after("quality_classifier")
    junk = {i for i, t, *_ in rows if t and "***" in t}
    assert not junk & {i for i, _ in kept} and len(kept) >= len(rows) - len(junk) - 3

    groups = {}
    for i, t in kept:
        groups.setdefault(norm(t), []).append(i)
    want = sorted(str(min((x for x in g if x is not None), default=None)) for g in groups.values())
    kept = after("exact_dedup")
    assert sorted(str(i) for i, _ in kept) == want

    root = five_word_groups([t for _, t in kept])
    first = {}
    for (i, _), c in zip(kept, root):
        first[c] = min((x for x in (first.get(c), i) if x is not None), default=None)
    kept = after("simhash_near_dedup")
    assert sorted(map(str, first.values())) == sorted(str(i) for i, _ in kept)

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    want = sorted(str(i) for i, t in kept if not plain_hits(t, items)[1])
    assert len(want) < len(kept)
    kept = after("benchmark_decontamination")
    assert sorted(str(i) for i, _ in kept) == want

    pieces = after("best_fit_packing")
    assert {str(r.doc_id) for r in pieces} == set(want)


def test_run_applies_all_stages(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert set(out.columns) >= {"doc_id", "piece", "sequence_id", "offset"} and out.count() > 50


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_entry_lists_every_operator():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
