"""Stages of the corpus pipeline against what each must do to its own input."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline
from folioflow.llm import quality

from .helpers import SCHEMA, groups_brute, lowered, odd_rows, repeats_brute, words


@pytest.fixture(scope="module")
def odd(spark):
    rows = odd_rows(3)
    path = corpus_pipeline.staged(spark.createDataFrame(rows, SCHEMA))
    return [tuple(r) for r in path.collect()], path


def test_all_but_the_last_keep_the_columns(spark, sf_dir, odd):
    docs = odd[1]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.staged(stage(spark, docs, sf_dir))
        assert docs.columns == odd[1].columns and docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() >= docs.count()


def test_quality_stage_drops_what_it_rejects(spark, sf_dir, odd):
    rows, df = odd
    got = Counter(tuple(r) for r in corpus_pipeline.quality_rules(spark, df, sf_dir).collect())
    passed = Counter(r for r in rows if not quality.base_failed(quality.statistics(r[1])[0]))
    assert got and not got - passed


def test_near_dedup_keeps_one_of_each_group(spark, sf_dir, odd):
    rows, df = odd

    def shingles(text):
        w = lowered(text)
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(r[1]) for r in rows]
    similar = lambda i, j: sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    root = groups_brute(len(rows), similar)
    got = Counter(r[0] for r in corpus_pipeline.simhash_near_dedup(spark, df, sf_dir).collect())
    expected = Counter(min((rows[i][0] is None, rows[i][0]) for i in range(len(rows)) if root[i] == g)[1] for g in {*root})
    assert got == expected


def test_substring_stage(spark, sf_dir, odd):
    rows, df = odd
    got = Counter((r.doc_id, tuple(words(r.text))) for r in corpus_pipeline.substring_dedup(spark, df, sf_dir).collect())
    assert got == Counter((d, tuple(x for x, h in zip(words(r[1]), hit) if not h)) for r, (d, hit) in zip(rows, repeats_brute(rows, 50)) if not (hit and all(hit)))


def test_mixing_stage_repeats_rows(spark, sf_dir, odd):
    rows, df = odd
    got = Counter(tuple(r) for r in corpus_pipeline.mixing_to_weights(spark, df, sf_dir).collect())
    once = Counter(rows)
    assert got and all(k in once and n <= 2 * once[k] for k, n in got.items())


def test_stages_on_an_empty_table(spark, sf_dir, odd):
    docs = corpus_pipeline.staged(odd[1].limit(0))
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, sf_dir)
        assert got.count() == 0 and (name == corpus_pipeline.STAGES[-1][0] or got.columns == docs.columns)


@pytest.mark.parametrize("stage", [corpus_pipeline.simhash_near_dedup, corpus_pipeline.substring_dedup, corpus_pipeline.mixing_to_weights])
def test_stages_do_not_depend_on_splits(spark, sf_dir, odd, stage):
    one, many = (corpus_pipeline.staged(odd[1].repartition(n)) for n in (1, 7))
    assert Counter(map(tuple, stage(spark, one, sf_dir).collect())) == Counter(map(tuple, stage(spark, many, sf_dir).collect()))


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "piece", "length", "sequence_id", "offset"} <= set(out.columns) and out.count()
