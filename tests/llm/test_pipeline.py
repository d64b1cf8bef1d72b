"""Each stage of the pipeline against the brute-force version of its operator, on what the stage before kept."""

from __future__ import annotations

import pytest

from tests.llm import brute
from tests.llm.test_operators import texts

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    rows = texts(5)
    item = next(t for _, t in rows if t and 60 < len(t.split()) < 120)
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item.split()[10:40]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "line_dedup", "near_duplicates", "decontamination", "packing"]

    def after(name, docs):
        out = stages[name](spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        assert out.columns == columns
        return out, [(r.doc_id, r.text) for r in out.collect()]

    docs, kept = after("quality", docs)
    assert all(not brute.quality(t)[5] for _, t in kept) and {i for i, t in rows if brute.quality(t)[5]}.isdisjoint(i for i, _ in kept)
    before, (docs, less) = kept, after("line_dedup", docs)
    want = {i: x[4] for (i, _), x in brute.lines(before).items() if not (x[2] and x[4] == brute.sha(""))}
    assert {i: brute.sha(t) for i, t in less} == want
    assert all(r.n_chars == len(r.text) for r in docs.collect())
    docs, one = after("near_duplicates", docs)
    assert {i for i, _ in one} == {i for i, (_, c) in brute.components(less).items() if i == c}
    docs, clean = after("decontamination", docs)
    hit = {x[0] for x in brute.contamination(one, [(1, " ".join(item.split()[10:40]))]) if x[5]}
    assert hit and {i for i, _ in clean} == {i for i, _ in one} - hit
    packed = stages["packing"](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {i for i, _ in clean}
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "ids_crc32").collect()) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in packed)
