"""The pipeline's stages against brute force, each on its own input."""

import numpy as np
import pyarrow as pa
import sentencepiece

import corpus_pipeline
from gritstone.llm import components, decontaminate, near_dedup, pieces, quality
from gritstone.llm.shared import stored

from .test_dedup import brute_lines
from .test_search import brute_overlaps


def test_each_stage_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "near_dedup", "decontamination", "sentencepiece"]
    inputs = [docs]
    for name, stage in corpus_pipeline.STAGES:
        inputs.append(stored(stage(spark, inputs[-1], sf_dir), f"test-{name}"))
        if name != "sentencepiece":
            assert inputs[-1].columns == docs.columns and inputs[-1].dtypes == docs.dtypes
    tables = [{r.doc_id: r for r in t.collect()} for t in inputs]
    start, good, lined, single, clean, coded = tables
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    keep = model.probability(quality.features(pa.array([r.text for r in start.values()]))) >= model.threshold
    assert set(good) == {i for i, k in zip(start, keep, strict=True) if k} and len(good) < len(start)
    assert all(good[i] == start[i] for i in good)
    want = brute_lines([(i, r.text) for i, r in good.items()])
    assert {i: r.text for i, r in lined.items()} == {i: t for i, t in want.items() if t.strip() or t == good[i].text}
    assert all(r.n_chars == len(r.text) for r in lined.values())
    ids = list(lined)
    rows, sig = near_dedup.signatures(pa.array([lined[i].text for i in ids]))
    a, b = np.nonzero(np.triu((sig[:, None] == sig[None]).sum(axis=2) >= near_dedup.MIN_EQUAL, 1))
    node, root = components.label_edges(np.array(ids)[rows[a]], np.array(ids)[rows[b]])
    assert set(single) == set(ids) - {int(n) for n, r in zip(node, root, strict=True) if n != r}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    seeds = decontaminate.make_seeds(pa.array([i for i, _ in items]), pa.array([t for _, t in items]))
    hit = {list(single)[k] for k in decontaminate.overlaps(seeds, pa.array([r.text for r in single.values()]))["row"]}
    assert set(clean) == set(single) - hit
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    assert set(coded) == set(clean) and all(r.ids == sp.encode(clean[i].text) and r.decodes for i, r in coded.items())
    whole = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert whole == {i: r.ids for i, r in coded.items()}
    assert brute_overlaps([], items, 12, 0.75) == set()
