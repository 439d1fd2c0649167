"""The pipeline's stages, each against plain Python on its own input."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from test_brute_force import WORD, near_components

from skein.llm import mixing, packing, toxicity
from skein.llm.common import cut

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = [docs]
    for name, stage in corpus_pipeline.STAGES:
        held.append(cut(stage(spark, held[-1], SF), name))
    return held


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_return_documents(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_exact(stages):
    first = {}
    for r in sorted(stages[1].collect(), key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r.doc_id)
    assert ids(stages[2]) == sorted(first.values())


def test_near(stages):
    texts = {r.doc_id: r.text or "" for r in stages[2].collect()}
    assert ids(stages[3]) == sorted({c for _, c in near_components(texts, 5, 80).values()})


def test_toxicity(stages):
    """The stage drops what a model fitted on the same labelled rows, in plain Python, calls toxic."""
    labels = {}
    for r in stages[0].sparkSession.read.parquet(f"{SF}/labels.parquet").collect():
        if zlib.crc32(str(r.doc_id).encode()) % 5:
            labels[r.doc_id] = max(labels.get(r.doc_id, 0), r.toxic)
    texts = {r.doc_id: r.text or "" for r in stages[0].collect()}
    by = [[texts[i] for i, x in labels.items() if x == k and i in texts] for k in (0, 1)]
    share = sum(labels.values()) / len(labels)
    model = toxicity.fit_texts(by[1], by[0], share)
    scores = dict(zip(texts, model.score(list(texts.values())), strict=True))
    assert ids(stages[1]) == sorted(i for i, s in scores.items() if s < 0.5)


def test_mixing(stages):
    """The stage keeps a document if its own draw is below the weight of its cell, as raked here."""
    rows = stages[3].select("doc_id", "text", "source", "lang", mixing.topic(stages[3].text).alias("topic"), mixing.drawn(stages[3].doc_id).alias("u")).collect()
    cells = Counter()
    for r in rows:
        cells[r.source or "", r.lang or "", r.topic] += len(WORD.findall(r.text or ""))
    names = sorted(cells)
    mass = np.array([cells[c] for c in names], float)
    codes = [np.unique([c[k] for c in names], return_inverse=True)[1] for k in range(3)]
    have = [np.bincount(c, mass) for c in codes]
    w = dict(zip(names, mixing.rake(mass, codes, [mixing._feasible(mixing.tempered(h) * mixing.BUDGET * mass.sum(), h) for h in have]), strict=True))
    assert ids(stages[4]) == sorted(r.doc_id for r in rows if r.u < w[r.source or "", r.lang or "", r.topic])


def test_packing(stages):
    out = stages[5].toPandas()
    assert sorted(out.doc_id.unique()) == ids(stages[4]) and out.groupby("sequence_id").length.sum().max() <= packing.CAPACITY


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == stages[5].count()
