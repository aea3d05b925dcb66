"""The pipeline's stages against brute force, each on its own input, and the registered queries."""

import importlib
import os

import pytest
from test_pairs import brute_components, brute_passages
from test_texts import brute_hits, brute_mix

import __spark_entry__
import corpus_pipeline
from loomgraph.llm import language, mixing
from loomgraph.storage import staged

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    outs, ins = {}, {}
    for name, stage in corpus_pipeline.STAGES:
        ins[name] = pairs(docs)
        if name == "mixture":
            rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
        docs = staged(stage(spark, docs, DATA), name)
        assert docs.columns == (COLUMNS if name != "mixture" else [*COLUMNS, "mix_epoch"])
        outs[name] = pairs(docs)

    first = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language.fit(first, language.remainder(first.doc_id, 4) != 2)
    rejected = {r.doc_id for r in language.predict(first, model).filter("rejected").collect()}
    assert sorted(outs["language"]) == sorted(p for p in ins["language"] if p[0] not in rejected)
    assert len(rejected) <= 0.02 * len(ins["language"])

    label, _ = brute_components(ins["near_duplicates"], percent=80)
    assert sorted(outs["near_duplicates"]) == sorted(p for p in ins["near_duplicates"] if label[p[0]] == p[0])

    left = dict(outs["repeated_passages"])
    for i, t, runs in brute_passages(ins["repeated_passages"]):
        whole = b"".join(t[s:e] for s, e in zip([0, *(e for _, e in runs)], [*(s for s, _ in runs), len(t)], strict=True))
        if runs and not whole.decode(errors="ignore"):
            assert i not in left
        else:
            assert (left[i] or "") == whole.decode(errors="ignore")

    dirty = {h[0] for h in brute_hits(ins["decontamination"], items) if h[-1]}
    assert sorted(outs["decontamination"]) == sorted(p for p in ins["decontamination"] if p[0] not in dirty)

    taken = {}
    for i, _ in outs["mixture"]:
        taken[i] = taken.get(i, 0) + 1
    assert taken == brute_mix(rows, mixing.Mix())


def test_run_and_registration(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0
    found = __spark_entry__.queries()
    assert "pipeline" in found and all(any(q.startswith(f"op{n}_") for q in found) for n in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(found)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, DATA), name)
        assert docs.count() == 0


def test_nothing_else_imports_the_subpackage():
    root = os.path.dirname(importlib.import_module("loomgraph").__file__)
    for folder, _, names in os.walk(root):
        if os.path.basename(folder) in ("llm", "__pycache__"):
            continue
        for n in names:
            if n.endswith(".py"):
                with open(os.path.join(folder, n)) as f:
                    assert "loomgraph.llm" not in f.read(), n
