"""Pipeline stages on a small table, each held against a plain version of itself."""

import re

import numpy as np
import pytest

import corpus_pipeline
from salespark.llm import common, quality, toxicity
from tests.llm.test_quality import plain
from tests.llm.test_simhash import components, fingerprint
from tests.llm.test_spans import SECRET

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = common.table(spark, DIR, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(common.written(stage(spark, out[-1], DIR), name))
    return out


def test_columns_and_whole_rows(steps):
    for before, after in zip(steps, steps[1:-1]):
        assert after.columns == steps[0].columns
        assert after.count() <= before.count()


def test_quality_and_toxicity(spark, steps, labels):
    rules = quality.fit(steps[0], labels)
    rejected = {r.doc_id for r in quality.judged(steps[0], rules).filter("__rule > 0").collect()}
    want = {r.doc_id for r in steps[0].collect() if not plain(r.text)[-1]} - rejected
    assert {r.doc_id for r in steps[1].collect()} == want
    model = toxicity.fit(steps[1], labels)
    rows = steps[1].collect()
    score = model.score([r.text.encode() for r in rows])
    assert {r.doc_id for r in steps[2].collect()} == {r.doc_id for r, s in zip(rows, score) if s < 0.3}


def test_one_document_of_each_group(steps):
    rows = sorted(steps[2].collect(), key=lambda r: r.doc_id)
    roots = components([fingerprint(r.text) for r in rows])
    assert {r.doc_id for r in steps[3].collect()} == {rows[r].doc_id for r in roots}


def test_secrets_are_gone_and_all_else_stays(steps):
    before = {r.doc_id: r for r in steps[3].collect()}
    after = {r.doc_id: r for r in steps[4].collect()}
    assert set(before) == set(after)
    for k, r in after.items():
        assert not any(valid(m) for pattern, valid in SECRET.values() for m in re.finditer(pattern, r.text))
        if before[k].text != r.text:
            parts = r.text.split("<SECRET>")
            assert before[k].text.startswith(parts[0]) and before[k].text.endswith(parts[-1])
        assert tuple(r)[2:] == tuple(before[k])[2:]


def test_packing(steps):
    docs = {r.doc_id for r in steps[4].collect()}
    rows = steps[5].collect()
    assert {r.doc_id for r in rows} == docs
    for k in docs:
        own = sorted((r for r in rows if r.doc_id == k), key=lambda r: r.start)
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1].tolist()]
        assert sum(r.length for r in own) == own[0].doc_tokens


def test_empty_and_odd_tables(spark, steps, tmp_path):
    odd = spark.createDataFrame(
        [(1, None, None, None, None), (None, "", "en", "s", 1), (2, "short", "en", "s", 1),
         (2, "word " * 300, "en", "s", 1), (3, " ".join(map(str, range(400))), "en", "s", 1),
         (3, " ".join(map(str, range(400))), "en", "s", 1)], steps[0].schema)
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            docs = common.written(stage(spark, docs, DIR), name)
        assert "sequence_id" in docs.columns
