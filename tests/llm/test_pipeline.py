"""Each stage of the pipeline against a brute-force version, on its own input."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from lodestone.llm import queries, sentencepiece, simhash
from lodestone.llm.common import Stash

from .test_dedup import brute_groups, brute_windows, similar_pairs
from .test_models import brute_targets


@pytest.fixture(scope="module")
def staged(spark, sf_dir):
    """(name, input rows, output rows) of every stage."""
    stash, docs, out = Stash(spark), spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = stash.save(stage(spark, docs, sf_dir))
        out[name] = (docs.collect(), after.collect(), after.columns)
        docs = after
    return out


def test_stages_keep_the_columns(staged):
    for name, (_, _, columns) in list(staged.items())[:-1]:
        assert columns == corpus_pipeline.COLUMNS, name


def test_toxicity(spark, sf_dir, staged):
    before, after, _ = staged["toxicity"]
    judged = queries.op6_toxicity_chain(spark, sf_dir).collect()
    clean = {r.doc_id for r in judged if not r.toxic}
    assert sorted(after) == sorted(r for r in before if r.doc_id in clean)
    assert 0 < len(after) < len(before)


def test_near_duplicates(staged):
    """Dropped is what a chain of links of all pairs of fingerprints joins to a lesser id; what is similar enough has one survivor."""
    before, after, _ = staged["simhash_near_dedup"]
    ids = [r.doc_id for r in before]
    wide = simhash._Wide([simhash.wide_fingerprint((r.text or "").encode().lower().split(), 5) for r in before], simhash.shares(0.8)[1])
    links = {(ids[i], ids[j]) for i in range(len(ids)) for j in np.flatnonzero(wide.close(np.full(len(ids), i), np.arange(len(ids)))).tolist()}
    component = brute_groups(ids, links)
    kept = {r.doc_id for r in after}
    assert len(after) == len(kept) and sorted(after) == sorted(r for r in before if r.doc_id in kept)
    assert all(component[k] != k for k in set(ids) - kept) and {component[k] for k in ids} <= kept
    close = [(a, b) for a, b, j in similar_pairs(before, 5) if j >= 0.9]
    assert close and not [p for p in close if p[0] in kept and p[1] in kept]


def test_passages(staged):
    before, after, _ = staged["substring_dedup"]
    want = brute_windows([(r.doc_id, r.text) for r in before], 35)
    text = {r.doc_id: r.text for r in before}
    kept = {k: text[k] if not gone else words.decode() for k, (n, gone, words) in want.items() if not gone or gone < n}
    assert {r.doc_id: r.text for r in after} == kept
    assert all(r.n_chars == len(r.text) for r in after if want[r.doc_id][1])


def test_mix(staged):
    before, after, _ = staged["mix_sources"]
    size = {r.doc_id: len(r.text.encode().split()) for r in before}
    copies, sizes, taken, source = Counter(r.doc_id for r in after), Counter(), Counter(), {r.doc_id: r.source for r in before}
    for k, n in size.items():
        sizes[source[k]] += n
        taken[source[k]] += n * copies[k]
    assert set(copies.values()) <= {1, 2} and {r.doc_id: r.text for r in after}.items() <= {r.doc_id: r.text for r in before}.items()
    for s, target in brute_targets(sizes).items():
        assert abs(taken[s] - target) <= max(0.02 * target, max(size[k] for k in size if source[k] == s) / 2)


def test_tokens(staged):
    before, after, _ = staged["sentencepiece"]
    coder = sentencepiece.Coder(sentencepiece.Model.parse(queries.tokenizer()))
    assert sorted(zip([r.doc_id for r in after], coder.decode([r.ids for r in after]), strict=True)) == sorted((r.doc_id, r.text) for r in before)
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in after)


def test_run(spark, sf_dir, staged):
    assert sorted(corpus_pipeline.run(spark, sf_dir).select("doc_id", "n_tokens").collect()) == sorted((r.doc_id, r.n_tokens) for r in staged["sentencepiece"][1])


def test_odd_documents(spark, tmp_path, sf_dir):
    """Nulls in any column, empty and repeated rows go through all stages."""
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    long = "word " * 50
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, long + "x", "en", "b", 9), (None, None, "en", "b", 9), (3, "one two three four five", "en", "a", 1), (3, "one two three four five", "en", "a", 1), (4, "z" * 3000, None, None, 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stash = Stash(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stash.save(stage(spark, docs, str(tmp_path)))
    assert all(r.round_trip or r.ids is None for r in docs.collect())
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stash.save(stage(spark, docs, str(tmp_path)))
    assert docs.collect() == []


def test_unlike_rows_that_share_an_id_stay(spark):
    """Of id 1 the near copy of id 0 goes and the two other texts stay, each once."""
    a, b, c = (" ".join(f"{k}{i * i % 97}" for i in range(60)) for k in "abc")
    rows = [(0, a), (1, a), (1, b), (1, c), (1, c), (None, b), (None, c + " " + " ".join(f"end{i}" for i in range(60)))]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, None)
    assert out.columns == corpus_pipeline.COLUMNS
    assert sorted((str(r.doc_id), r.text) for r in out.collect()) == sorted([("0", a), ("1", b), ("1", c), ("None", rows[-1][1])])
