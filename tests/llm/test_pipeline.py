from __future__ import annotations

import importlib
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute
from test_operators import DOCS, prose, toxic_documents

from filigree.llm import packing


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    import random

    rng = random.Random(7)
    d, labels = toxic_documents(600)
    passage = prose(rng, 80)
    extra = []
    for i in range(60):
        t = prose(rng, 150)
        extra.append((1000 + 3 * i, t, "en", f"s{i % 3}", len(t)))
        if i % 2:
            extra.append((1001 + 3 * i, t.replace(t.split()[70], "edited", 1), "en", "s1", len(t)))
        if i % 5 == 0:
            u = f"{prose(rng, 60)}\n{passage}\n{prose(rng, 40)}"
            extra.append((1002 + 3 * i, u, "en", "s2", len(u)))
    whole = prose(rng, 70)
    extra += [(4000 + k, t, "en", "s0", len(t)) for k, t in enumerate([whole, whole + "\n", f"\n{whole}\n\n"])]
    extra += [(5000, None, None, None, None), (5001, "", "en", None, 0), extra[0]]
    place = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(d + extra, DOCS).write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    return str(place)


def test_stages(spark, tables):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in pipeline.STAGES:
        before = docs
        docs = pipeline.materialise(stage(spark, docs, tables), name)
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns, name
    before, after = seen["toxicity"]
    gone = {r.doc_id for r in before.select("doc_id").subtract(after.select("doc_id")).collect()}
    bad = {i for i in range(0, 600, 4)}
    assert len(gone & bad) >= 0.95 * len(bad) and len(gone - bad) <= 5
    before, after = seen["line_dedup"]
    rows = [((1 << 63) - 1 if r.doc_id is None else r.doc_id, r.text) for r in before.collect()]
    cut = brute.line_runs(rows, 50)
    want = []
    for (i, t), g in zip(rows, cut, strict=True):
        kept = "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in g) if g else t
        if not g or brute.WORD.search(kept):
            want.append((i, kept))
    assert brute.multiset((r.doc_id, r.text) for r in after.select("doc_id", "text").collect()) == brute.multiset(want)
    assert not after.filter("doc_id in (4001, 4002)").count() and after.filter("doc_id = 4000").count() == 1
    assert sum(map(bool, cut)) >= 10 and all(r.n_chars == len(r.text) for r in after.filter("doc_id between 1000 and 1200").collect())
    before, after = seen["simhash_near_dedup"]
    texts = [r.text for r in before.collect()]
    sets = [set(brute.shingles(t, 5)) for t in texts]
    assert after.count() == len(set(brute.groups(len(texts), lambda a, b: brute.jaccard(sets[a], sets[b]) >= 0.8)))
    before, after = seen["mixing"]
    most = {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()}
    assert max(most.values()) <= 3 and set(most) <= {r.doc_id for r in before.collect()}
    before, after = seen["packing"]
    pieces = sorted(after.collect(), key=lambda r: (r.sequence_id, r.offset))
    at = 0
    for r in pieces:
        assert r.sequence_id * 2048 + r.offset == at
        at += r.length
    encode = packing.load_encoder(packing.default_tokenizer())
    assert at == sum(len(encode(r.text or "")) + 1 for r in before.collect())


def test_pipeline_of_nothing(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
