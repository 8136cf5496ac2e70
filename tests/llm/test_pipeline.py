"""The pipeline against the same stages by plain loops."""

from __future__ import annotations

import corpus_pipeline
from tickloom.llm import quality

from . import brute


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = {r.doc_id: r.text for r in quality.keep_good(docs).collect()}
    lines = brute.lines(list(text.items()))
    kept = {}
    key = lambda x: x.strip(brute.SPACE).translate(brute.UPPER)
    holders: dict = {}
    for i, t in text.items():
        for x in (t or "").split("\n"):
            holders.setdefault(key(x), set()).add(i)
    for i, t in text.items():
        left = [x for x in (t or "").split("\n") if not (len(key(x)) >= 40 and len(holders[key(x)]) >= 5 and max(holders[key(x)]) != i)]
        kept[i] = "\n".join(left)
        assert brute.sha(kept[i]) == lines[i][2]
    near = brute.near(list(kept.items()))
    kept = {i: t for i, t in kept.items() if near[i][0] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    hit = brute.passages(list(kept.items()), items)
    want = {i: t for i, t in kept.items() if not hit[i][4]}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert want and set(got) == set(want)
    assert all(got[i].text == t and got[i].agenda_agrees and len(got[i].ids) == got[i].n_tokens for i, t in want.items())
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "quality_rules" and len(corpus_pipeline.STAGES) == 5


def test_stages_keep_columns_and_take_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, sf_dir)
        assert made.count() == 0
        if name != "piece_codec":
            assert made.columns == docs.columns, name
