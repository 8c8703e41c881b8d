"""The registered queries themselves, and plain versions of models that SQL can't express."""

from __future__ import annotations

import math
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from folioflow.llm import language, media, quality, rans, tokens, toxicity
from folioflow.llm.queries import ORACLE_SQL, QUERIES, _vocabulary

from .helpers import crc_fold, odd_rows, simhash_brute


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.execute(ORACLE_SQL[name])
    columns = sorted(c[0] for c in want.description)
    place = [c[0] for c in want.description]
    want = Counter(tuple(r[place.index(c)] for c in columns) for r in want.fetchall())
    got = QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == columns
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == want


def test_fingerprints(spark, sf_dir, rows):
    got = QUERIES["op2_simhash_near_dedup"](spark, sf_dir).collect()
    assert {g.doc_id: g.fingerprint for g in got} == {k: f"{simhash_brute(r.text):016x}" for k, r in rows.items()}


def test_held_out_and_predictions(spark, sf_dir, rows):
    found = {n: {g.doc_id: g for g in QUERIES[n](spark, sf_dir).collect()} for n in ("op3_language_id", "op8_toxicity")}
    for got in found.values():
        assert got.keys() == rows.keys() and all(g.held_out == (crc_fold(k, 5) == 0) and 0 <= g.score <= 1 for k, g in got.items())
    assert all(g.predicted == int(g.score >= 0.5) for g in found["op8_toxicity"].values())


def plain_language(profiles, text):
    """Rank-order distance by dictionaries and sorted lists."""
    letters = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    if not letters:
        return "und"
    line = f" {' '.join(letters)} "
    grams = Counter(line[i : i + n] for n in (1, 2, 3) for i in range(len(line) - n + 1))
    grams = {g: c for g, c in grams.items() if g.strip() and " " not in g[1:-1]}
    own = sorted(grams, key=lambda g: (-grams[g], sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))))[: language.TOP]
    far = {}
    for lang, ranks in profiles.items():
        far[lang] = sum(min(abs(ranks[g] - k), language.PROFILE) if g in ranks else language.PROFILE for k, g in enumerate(own))
    return min(sorted(far), key=far.get)


def test_language_against_plain_distance(spark, sf_dir, rows):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.fit(language.training_rows(docs))
    profiles = {}
    for k, lang in enumerate(model.languages):
        some = model.ranks[:-1, k] >= 0
        names = ["".join(chr(int(x) >> s & 0x1FFFFF) for s in (42, 21, 0) if int(x) >> s & 0x1FFFFF) for x in model.keys[some]]
        profiles[lang] = dict(zip(names, model.ranks[:-1, k][some].tolist()))
    for text in [r.text for r in rows.values()][:60] + [r[1] for r in odd_rows()]:
        assert model.predict(text)[0] == plain_language(profiles, text)


@pytest.mark.parametrize("text", ["½", "²", "①", "Ⅳ", "½ ² ①", "12 _ 3", "", None])
def test_signs_are_no_letters(text):
    profiles = language.Profiles({"x": language.ranked(*language.ngram_counts("aba"), 9)})
    assert profiles.predict(text) == ("und", 0.0)


def test_toxicity_against_plain_matching(spark, sf_dir, rows):
    """Every lexicon entry looked for at every word, without an automaton."""
    kinds = ["a killer whale swims", "the killer speaks of killings", "calm sea", "a killer of idi0ts", "calm wind", "the killer idiot", "no one here", "stup1d killer"]
    docs = spark.createDataFrame([(i, f"{kinds[i % 8]} number{i} {'again ' * (i % 4)}") for i in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(600)], "doc_id long, quality int, toxic int")
    lexicon = toxicity.fit(docs, labels)
    assert lexicon.words and lexicon.phrases and any(k.endswith("*") for k in lexicon.words)

    def plain(text):
        words = toxicity.fold_text(text).split()
        total = 0.0
        for w in words:
            best = max((k for k in lexicon.words if (w == k if k[-1] != "*" else w.startswith(k[:-1]))), key=lambda k: (len(k) + 1 if k[-1] != "*" else len(k)), default=None)
            total += lexicon.words[best] if best else 0
        line = f" {' '.join(words)} "
        less = sum(v * len(re.findall(f"(?= {re.escape(k)} )", line)) for k, v in lexicon.phrases.items())
        total, n = max(0.0, total - less), max(1, len(words))
        x = (total / 10, total / math.sqrt(n), 10 * total / (n + 20), math.log1p(n) / 5)
        return 1 / (1 + math.exp(-max(-40, min(40, lexicon.curve[-1] + sum(c * v for c, v in zip(lexicon.curve, x))))))

    for text in [r.text for r in docs.limit(60).collect()] + [r.text for r in rows.values()][:40] + [r[1] for r in odd_rows()]:
        assert math.isclose(lexicon.score(text), plain(text), rel_tol=1e-9)


def test_forest_path_lengths_against_a_plain_walk():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3))
    forest = quality.IsolationForest(x, 20)
    for row, got in zip(x[:40], forest.score(x[:40])):
        total = 0.0
        for feature, split, left, right, path in forest.trees:
            at = 0
            while feature[at] >= 0:
                at = left[at] if row[feature[at]] <= split[at] else right[at]
            total += path[at]
        assert math.isclose(got, 2 ** (-total / 20 / float(quality._average_path(forest.size))), rel_tol=1e-9)


def test_two_labels_of_one_document(spark):
    docs = spark.createDataFrame([(i, f"text number {i} " + "word " * (i % 7 + 12)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 30, i % 2, i // 30) for i in range(60)], "doc_id long, quality int, toxic int")
    assert quality.judge(docs, quality.fit(docs, labels)).count() == 60
    assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == 60


def test_tensors_keep_their_arrow_type(spark):
    docs = spark.createDataFrame([(1, "some text " * 900), (2, None)], "doc_id long, text string")
    stored = media.store_media(docs)
    blobs = {r.doc_id: media.features(media.from_wav(bytes(r.media))) for r in stored.collect()}
    for r in media.store_tensors(stored).collect():
        windows, (mel, found) = media.read_tensors(bytes(r.windows)), blobs[r.doc_id]
        assert windows.schema.field("tensor").type == pa.fixed_shape_tensor(pa.float32(), [media.TENSOR_FRAMES, media.MELS])
        assert windows.num_rows == r.n_windows
        assert (windows.column("tensor").to_numpy_ndarray().reshape(-1, media.MELS)[: len(mel)] == mel).all()
        active = sum((b - a) * s for a, b, s in zip([0] * r.n_windows, [min(64, len(mel) - 64 * k) for k in range(r.n_windows)], windows.column("active").to_pylist()))
        assert round(active) == sum(b - a for a, b in found)


@pytest.mark.parametrize(("name", "leading", "dtype"), [("byte_bpe_50k.json", True, "<u4"), ("word_bpe_49k.json", False, "<u2")])
@pytest.mark.parametrize("as_text", [True, False])
def test_tokenizer_against_the_library(name, leading, dtype, as_text, rows):
    """With and without ids of added tokens, on texts with odd white space, scripts, marks and contractions."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(_vocabulary(name))
    plain.encode_special_tokens = as_text
    texts = ["a <|endoftext|> b", "<|ENDOFTEXT|>x", "don't  stop\t'tis", "a b\u0085c d", "日本 語 text", "①½ x²", "a.'s b're5 x'rex A1B2'", " \n x", "Élan É.x é.é éx", "ΑΣ ς Σ.", None, ""]
    texts += [r.text for r in rows.values()] + [r[1] for r in odd_rows()]
    memo = tokens.MemoTokenizer(_vocabulary(name), leading, dtype, 2000, as_text)
    for _ in range(2):  # the second time from the memo, or after it was shrunk
        for a in range(0, len(texts), 50):
            ids, at = memo.encode(texts[a : a + 50])
            for k, text in enumerate(texts[a : a + 50]):
                assert ids[at[k] : at[k + 1]].tolist() == plain.encode(text or "", add_special_tokens=False).ids


def test_packing_keeps_large_ids_beside_null(spark):
    from folioflow.llm import packing

    docs = spark.createDataFrame([(None, "a"), ((1 << 53) + 1, "b c"), (-5, "d")], "doc_id long, text string")
    got = packing.pack_documents(docs, _vocabulary("byte_bpe_50k.json"), ids=False).collect()
    assert {g.doc_id for g in got} == {None, (1 << 53) + 1, -5}


def test_token_files_are_read_by_a_new_session(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(30)
    rans.write_token_files(docs, _vocabulary("word_bpe_49k.json"), f"file://{tmp_path}/t", block_tokens=3000)
    got = rans.read_token_files(spark.newSession(), f"file://{tmp_path}/t").collect()
    assert len(got) == 30 and all(zlib.crc32(np.array(g.ids, "<u4").tobytes()) == g.ids_crc32 for g in got)


def test_near_copies_of_a_whole_table_against_exact_search(spark):
    """All pairs at a similarity of 0.8, found by the rarest shingles of each set, give the same components."""
    from folioflow.llm import simhash

    path = "/root/testdata/sf0.1/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("needs the larger table")
    docs = spark.read.parquet(path)
    ids, texts = zip(*((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()))
    sets = [simhash.distinct(simhash.shingle_hashes(t, 5)) for t in texts]
    root, least = list(range(len(ids))), 0.8

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join(i, j):
        a, b = sorted((find(i), find(j)), key=lambda k: ids[k])
        root[b] = a

    first: dict[bytes, int] = {}
    for i, s in enumerate(sets):
        join(i, first.setdefault(s.tobytes(), i))
    values = np.sort(np.concatenate([sets[i] for i in first.values()]))
    seen: dict[int, list[int]] = {}
    for i in sorted(first.values(), key=lambda i: len(sets[i])):
        s, n = sets[i], len(sets[i])
        often = np.searchsorted(values, s, side="right") - np.searchsorted(values, s)
        rare = s[np.lexsort((s, often))][: n - math.ceil(least * n) + 1 if n else 0].tolist()
        for j in {j for h in rare for j in seen.get(h, ())}:
            both = len(np.intersect1d(s, sets[j], assume_unique=True))
            if both >= least * (n + len(sets[j]) - both):
                join(i, j)
        for h in rare:
            seen.setdefault(h, []).append(i)
    assert {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()} == {k: ids[find(i)] for i, k in enumerate(ids)}
