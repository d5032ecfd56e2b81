"""SimHash, window and suffix dedup against brute force, on texts with every odd case."""

import hashlib
import pathlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import simhash, substring_dedup, suffix_dedup
from lodestone.llm.common import Stash, forest, merge_spans, sliding_argmin
from lodestone.llm.components import components

ROWS = "doc_id long, text string, keep int, n_words int, row string"


def texts(seed=0, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeäß") for _ in range(rng.randint(1, 5)))
    passage = [word() for _ in range(60)]
    out = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(0, 120))]
        if i % 3 == 0:
            at = rng.randint(0, len(words))
            words[at:at] = passage[rng.randint(0, 10) :]
        out.append(" ".join(words))
    out += ["", None, "x", "a b", "  ", "same text " * 30, "same text " * 30, out[0], out[0], "zz " * 400, "=" * 300, "=" * 250, " ".join(passage) + "\n\tTail", "word glued " * 20]
    out += [out[1] + " more", "lead " + out[1], "y" * 5000 + " " + out[3]]
    return list(enumerate(out))


def frame(spark, rows):
    return spark.createDataFrame([(k, t, 1, 2, "r") for k, t in rows], ROWS)


def brute_windows(rows, size):
    words = {k: (t or "").encode().split() for k, t in rows}
    count = Counter(tuple(w[i : i + size]) for w in words.values() for i in range(len(w) - size + 1))
    want = {}
    for k, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if count[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        want[k] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return want


@pytest.mark.parametrize(("window", "bucket"), [(35, 4096), (35, 2), (5, 2), (2, 4096)])
def test_windows(spark, window, bucket):
    rows = texts()
    out = substring_dedup.remove_repeated_windows(frame(spark, rows), Stash(spark), window=window, bucket=bucket).collect()
    assert {r.row.doc_id: (r.n_words, r.n_removed, bytes(r.kept)) for r in out} == brute_windows(rows, window)
    assert out[0].row.keep == 1 and out[0].row.n_words == 2 and out[0].row.row == "r"


def test_windows_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (1, text), (None, "other words here"), (2, "short")]
    out = substring_dedup.remove_repeated_windows(frame(spark, rows), Stash(spark)).collect()
    assert sorted((r.n_words, r.n_removed) for r in out) == [(1, 0), (3, 0), (40, 40), (40, 40)]


def brute_bytes(rows, size):
    seen, want = set(), {}
    for k, t in sorted(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - size + 1):
            w = b[i : i + size]
            if w in seen:
                gone[i : i + size] = True
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want[k] = (len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return want


@pytest.mark.parametrize(("length", "bucket", "block"), [(100, 4096, 1 << 20), (100, 2, 2000), (48, 4096, 500), (101, 3, 3000)])
def test_suffixes(spark, length, bucket, block):
    rows = [(k, t) for k, t in texts(1)]
    out = suffix_dedup.remove_repeats(frame(spark, rows), Stash(spark), length=length, bucket=bucket, block=block).collect()
    assert {r.row.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out} == brute_bytes(rows, length)


def crowd(n):
    """n texts around one passage: most of its buckets hold n different pieces."""
    passage = " ".join(f"word{i * i % 89}" for i in range(60))
    return [(i, f"{i} lead{i * 7919 % 10007} " * 3 + passage + f" tail{i} {i * i} " * 3) for i in range(n)]


def test_suffixes_of_a_crowded_bucket(spark):
    rows = crowd(5000)
    out = suffix_dedup.remove_repeats(frame(spark, rows), Stash(spark)).collect()
    assert {r.row.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out} == brute_bytes(rows, 100)


def test_windows_of_a_crowded_bucket(spark):
    rows = crowd(5000)
    out = substring_dedup.remove_repeated_windows(frame(spark, rows), Stash(spark)).collect()
    assert {r.row.doc_id: (r.n_words, r.n_removed, bytes(r.kept)) for r in out} == brute_windows(rows, 35)


def test_very_long_texts_are_cut_into_stretches(spark, monkeypatch):
    rows = [(0, "lead " + " ".join(f"w{i % 977}" for i in range(6000))), (1, " ".join(f"w{i % 977}" for i in range(300, 500))), (2, "alone")]
    monkeypatch.setattr(suffix_dedup, "STRETCH", 1000)
    monkeypatch.setattr(substring_dedup, "STRETCH", 1000)
    out = suffix_dedup.remove_repeats(frame(spark, rows), Stash(spark)).collect()
    assert {r.row.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out} == brute_bytes(rows, 100)
    out = substring_dedup.remove_repeated_windows(frame(spark, rows), Stash(spark)).collect()
    assert {r.row.doc_id: (r.n_words, r.n_removed, bytes(r.kept)) for r in out} == brute_windows(rows, 35)


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "x", 2, 3, 4)], "doc_id long, text string, `my col` int, `a.b` int, `c:d``e` int")
    for out in (suffix_dedup.remove_repeats(df, Stash(spark)), substring_dedup.remove_repeated_windows(df, Stash(spark)), simhash.near_duplicates(df, Stash(spark))):
        row = out.first().row
        assert (row["my col"], row["a.b"], row["c:d`e"]) == (2, 3, 4)


def test_suffixes_repeated_rows_and_null_ids(spark):
    text = "".join(chr(97 + (i * i) % 23) for i in range(90)) + "0123456789" * 3
    rows = [(1, text), (1, text), (None, text), (0, "z")]
    out = suffix_dedup.remove_repeats(frame(spark, rows), Stash(spark)).collect()
    assert sorted((str(r.row.doc_id), r.n_removed) for r in out) == [("0", 0), ("1", 0), ("1", 0), ("None", 120)]


def colliding(n):
    """n pairs of texts whose hashes agree in the last 24 bits."""
    rng, seen, out = random.Random(3), {}, []
    while len(out) < n:
        t = "".join(rng.choice("abcdefgh ") for _ in range(220))
        h = xxhash.xxh64_intdigest(t.encode(), 42) & 0xFFFFFF
        if h in seen:
            out.append((seen[h], t))
        seen[h] = t
    return out


@pytest.mark.parametrize("doc_id", [None, 7])
@pytest.mark.parametrize("bucket", [4096, 2])
def test_suffixes_rows_that_share_an_id(spark, doc_id, bucket):
    pairs = colliding(3)
    rows = [(doc_id, t) for pair in pairs for t in pair] + [(1, "x" + pairs[0][0][:150]), (2, pairs[1][1][20:180])]
    out = suffix_dedup.remove_repeats(frame(spark, rows), Stash(spark), bucket=bucket).collect()
    kept = Counter((r.row.doc_id, bytes(r.kept).decode()) for r in out)
    want = Counter((doc_id, t) for pair in pairs for t in pair) + Counter(rows[-2:])
    want -= Counter([(doc_id, pairs[0][0]), (doc_id, pairs[1][1])])
    assert kept == want + Counter([(doc_id, pairs[0][0][150:]), (doc_id, pairs[1][1][:20] + pairs[1][1][180:])])


def test_suffixes_copies_without_ids(spark):
    text = colliding(1)[0][0]
    out = suffix_dedup.remove_repeats(frame(spark, [(None, text)] * 5 + [(None, None), (None, "short")]), Stash(spark)).collect()
    assert sorted(r.n_removed for r in out) == [0, 0, 0, 220, 220, 220, 220]


def test_difference_cover():
    cover = suffix_dedup.difference_cover(16)
    assert {(a - b) % 16 for a in cover for b in cover} == set(range(16)) and len(cover) == 5


def brute_print(text, size=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def shingles(text, size):
    w = (text or "").lower().split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def similar_pairs(rows, size):
    """(id, id, Jaccard similarity) of all pairs that share a shingle."""
    sets = {r.doc_id: shingles(r.text, size) for r in rows}
    by_shingle = {}
    for k, own in sets.items():
        for x in own:
            by_shingle.setdefault(x, []).append(k)
    pairs = Counter((a, b) for own in by_shingle.values() for a in own for b in own if a < b)
    return [(a, b, n / (len(sets[a]) + len(sets[b]) - n)) for (a, b), n in pairs.items()]


def brute_groups(ids, links):
    """The least id that links reach, for each."""
    least = {k: k for k in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(least[a], least[b])
            if (least[a], least[b]) != (low, low):
                least[a] = least[b] = low
                changed = True
    return least


def similar_rows(n=150, words=200, seed=9):
    """Texts, a copy of each with some words changed, and unrelated ones."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    rows = []
    for i in range(n):
        text = [word() for _ in range(words)]
        copy = list(text)
        for at in rng.sample(range(words), rng.randint(0, 5)):
            copy[at] = word()
        rows += [(3 * i, " ".join(text)), (3 * i + 1, " ".join(copy)), (3 * i + 2, " ".join(text[:100] + [word() for _ in range(100)]))]
    return rows


@pytest.mark.parametrize("bucket", [2048, 3])
def test_similar_groups(spark, bucket):
    rows = similar_rows()
    out = simhash.similar_groups(frame(spark, [*rows, (None, rows[0][1]), (900, None), (901, " "), (902, "few words")]), Stash(spark), bucket=bucket).collect()
    group = {r.row.doc_id: r.component for r in out}
    assert len(out) == len(rows) + 4 and group[None] == group[0] and group[900] == group[901] != group[902] and out[0].row.keep == 1
    found = {True: Counter(), False: Counter()}
    for a, b, j in similar_pairs([r for r in frame(spark, rows).collect()], 5):
        found[group[a] == group[b]][int(20 * j)] += 1
    hit = lambda low, high: sum(found[True][x] for x in range(low, high)) / max(1, sum(found[True][x] + found[False][x] for x in range(low, high)))
    assert hit(18, 21) >= 0.98 and hit(16, 18) >= 0.8 and hit(0, 11) == 0


def test_connect_by_brute_force():
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**64, (6, simhash.WIDE), np.uint64)
    flips = [sum(1 << int(b) for b in rng.choice(256, 26, replace=False)) for _ in range(200)]
    prints = [(int.from_bytes(centres[i % 6].tobytes(), "little") ^ f).to_bytes(32, "little") for i, f in enumerate(flips)]
    most = simhash.shares(0.8)[1]
    a, b = simhash._Wide(prints, most).connect(np.arange(200))
    value = [int.from_bytes(p, "little") for p in prints]
    links = [(i, j) for i in range(200) for j in range(i) if (value[i] ^ value[j]).bit_count() <= most]
    assert links and brute_groups(range(200), list(zip(a.tolist(), b.tolist(), strict=True))) == brute_groups(range(200), links)


def brute_components(prints):
    ids = sorted(prints)
    root = {k: k for k in ids}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in ids}


def test_fingerprints_match_sparks_hash(spark):
    h = spark.sql("select xxhash64('a b c') as h").first().h
    assert h & (2**64 - 1) == xxhash.xxh64_intdigest(b"a b c", 42)


@pytest.mark.parametrize("bucket", [2048, 2])
def test_simhash(spark, bucket):
    rows = texts(2)
    out = simhash.near_duplicates(frame(spark, rows), Stash(spark), bucket=bucket).collect()
    prints = {k: brute_print(t) for k, t in rows}
    want = brute_components(prints)
    assert {r.row.doc_id: (r.print & (2**64 - 1), r.component_id) for r in out} == {k: (prints[k], want[k]) for k in prints}


@pytest.mark.parametrize("bucket", [2048, 4])
def test_links_by_bits(spark, bucket):
    """Chains of fingerprints that differ in up to four bits, anywhere."""
    rng = random.Random(5)
    prints = {}
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(6):
            prints.setdefault(x, len(prints))
            for b in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << b
    df = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)), i) for p, i in prints.items()], "print long, rep long")
    stash = Stash(spark)
    found = {r.node: r.component for r in components(simhash.links(df, stash, bucket), stash).collect()}
    want = brute_components({i: p for p, i in prints.items()})
    assert {i: found.get(i, i) for i in want} == want


def test_simhash_nulls(spark):
    out = simhash.near_duplicates(frame(spark, [(None, "a b c d"), (None, None), (3, "a b c d"), (3, "a b c d")]), Stash(spark)).collect()
    assert sorted((str(r.row.doc_id), str(r.component_id)) for r in out) == [("3", "3"), ("3", "3"), ("None", "3"), ("None", "None")]


def test_simhash_links_through_rows_without_ids(spark, monkeypatch):
    """5 and 8 are linked only through a null id; 2 stands at two fingerprints that nothing links."""
    prints = {"a": 0, "b": 7, "c": 63, "d": -1 << 40, "e": 0x5555555555555555, "f": 0x5555555555555554}
    shown = lambda docs, size, text: docs.select(F.struct("doc_id").alias("row"), F.expr("case text " + " ".join(f"when '{k}' then {v}L" for k, v in prints.items()) + " end").alias("print"))
    monkeypatch.setattr(simhash, "fingerprints", shown)
    rows = [(5, "a"), (None, "b"), (8, "c"), (2, "d"), (2, "e"), (9, "f"), (None, "d")]
    out = simhash.near_duplicates(frame(spark, rows), Stash(spark)).collect()
    assert {(r.row.doc_id, r.print): r.component_id for r in out} == {(5, 0): 5, (None, 7): 5, (8, 63): 5, (2, -1 << 40): 2, (None, -1 << 40): 2, (2, 0x5555555555555555): 2, (9, 0x5555555555555554): 2}
    rows = [(5, "a"), (5, "e"), (3, "b"), (4, "f")]
    out = simhash.near_duplicates(frame(spark, rows), Stash(spark)).select("row.doc_id", "print", "component_id").collect()
    assert {(r.doc_id, r.component_id) for r in out} == {(5, 3), (3, 3), (5, 4), (4, 4)}


@pytest.mark.parametrize("rows", [[], [(1, 2), (2, 3), (9, 8), (5, 5), (3, 1), (None, 4)], [(i, i + 1) for i in range(50)], [(0, i) for i in range(1, 40)]])
def test_components(spark, rows):
    stash = Stash(spark)
    found = {r.node: r.component for r in components(spark.createDataFrame(rows, "a long, b long"), stash).collect()}
    root = {}
    for a, b in rows:
        if a is not None and a != b:
            root.setdefault(a, a), root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in rows:
            if a is not None and a != b and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    assert found == root


@pytest.mark.parametrize("op", [substring_dedup.remove_repeated_windows, suffix_dedup.remove_repeats, simhash.near_duplicates])
def test_empty_table(spark, op):
    assert op(spark.createDataFrame([], ROWS), Stash(spark)).collect() == []


def test_helpers():
    rng = np.random.default_rng(1)
    for width in (1, 2, 7, 33):
        v = rng.integers(0, 9, 200).astype(np.uint64)
        assert sliding_argmin(v, width).tolist() == [i + int(np.argmin(v[i : i + width])) for i in range(200 - width + 1)]
    s, e = merge_spans(np.array([5, 1, 3, 9]), np.array([8, 3, 4, 10]))
    assert list(zip(s.tolist(), e.tolist(), strict=True)) == [(1, 4), (5, 8), (9, 10)]
    a, b = forest(np.array([4, 7, 2]), np.array([7, 2, 2]))
    assert dict(zip(a.tolist(), b.tolist(), strict=True)) == {4: 2, 7: 2}


def test_rejoin_keeps_clean_texts(spark):
    df = frame(spark, [(1, "keep  my\nspaces")])
    assert bytes(substring_dedup.remove_repeated_windows(df, Stash(spark), rejoin=False).first().kept) == b"keep  my\nspaces"
    assert df.select(F.sha2("text", 256)).count() == 1


def test_a_saved_table_leaves_no_shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()

    def files():
        return {f for d in dirs for f in pathlib.Path(str(d)).glob("**/shuffle_*.data")}

    before = files()
    saved = Stash(spark).save(spark.range(10_000).repartition(3, "id"))
    assert not files() - before and saved.count() == 10_000
    twice = saved.repartition(3, "id").groupBy((F.col("id") % 5).alias("k")).count()
    assert len(twice.collect()) == len(twice.collect()) == 5
