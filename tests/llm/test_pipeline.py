"""The pipeline's stages one by one, each against brute force on its own input."""

import importlib.util

import pytest

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("the pipeline isn't here", allow_module_level=True)
import corpus_pipeline  # noqa: E402
import tiktoken  # noqa: E402
from strandline.llm import bpe, mixing, pii, toxicity  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    frames = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR).cache()
        frames[name] = docs
        if name != "bpe":
            assert docs.columns == columns
    model = toxicity.fit_on(spark.read.parquet(f"{SF_DIR}/documents.parquet"), spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    scorer = toxicity.Scorer(model)
    clean = {i for i, r in before.items() if not model.decide(*scorer.count([r.text])[0])}
    assert {r.doc_id for r in frames["toxicity"].collect()} == clean
    sets = {}
    for i in clean:
        w = (before[i].text or "").lower().split()
        sets[i] = {tuple(w[k : k + 2]) for k in range(len(w) - 1)} or ({tuple(w)} if w else set())
    group = {i: i for i in clean}
    for a in sorted(clean):
        for b in sorted(clean):
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b]):
                x, y = group[a], group[b]
                group = {k: min(x, y) if g in (x, y) else g for k, g in group.items()}
    assert {r.doc_id for r in frames["near_copies"].collect()} == set(group.values())
    redacted = {r.doc_id: r for r in frames["pii"].collect()}
    assert redacted.keys() == set(group.values())
    for i, r in redacted.items():
        (spans,) = pii.find([before[i].text], pii.fit_model())
        assert r.text == pii.redacted(before[i].text, spans) and r.n_chars == len(r.text)
    epochs = {r.source: r.epochs for r in mixing.source_epochs(frames["pii"]).collect()}
    mixed = {}
    for r in frames["mixing"].collect():
        mixed[r.doc_id] = mixed.get(r.doc_id, 0) + 1
    assert all(int(epochs[r.source]) <= mixed.get(i, 0) <= int(epochs[r.source]) + 1 for i, r in redacted.items())
    enc = tiktoken.Encoding("own", pat_str=r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=bpe.read_ranks(), special_tokens={})
    rows = frames["bpe"].collect()
    assert len(rows) == sum(mixed.values())
    assert all(r.round_trip and r.tokens == enc.encode_ordinary(redacted[r.doc_id].text) for r in rows)


def test_empty(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
    assert docs.count() == 0


def test_bpe_stage_plans_no_table(spark):
    """The last stage leaves nothing of the corpus to the driver: no subquery, and no shuffle."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    plan = corpus_pipeline.tokenize(spark, docs, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "Subquery" not in plan and "Exchange" not in plan
