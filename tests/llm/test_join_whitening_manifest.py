"""The n-gram join and whitening against brute force, the manifest against SQL and a tree built by hand."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.llm import merkle, ngram_join, queries, whitening

SF = "/root/testdata/sf0.001"
WORDS = [f"w{i}" for i in range(3000)]


def shingles(text, words):
    found = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if x]
    return frozenset(tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))) if found else frozenset()


def naive_join(rows, words, percent):
    """(id, size, component, links) of every row, from all pairs that share a shingle."""
    sets, parent, links = [(i, shingles(t, words)) for i, t in rows], {i: i for i, _ in rows}, [0] * len(rows)
    holders: dict = {}
    for a, (_, s) in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(a)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, (i, s) in enumerate(sets):
        common: dict = {}
        for g in s:
            for b in holders[g]:
                if b > a:
                    common[b] = common.get(b, 0) + 1
        for b, k in common.items():
            if 100 * k >= percent * (len(s) + len(sets[b][1]) - k):
                links[a] += 1
                links[b] += 1
                x, y = root(i), root(sets[b][0])
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), root(i), links[a]) for a, (i, s) in enumerate(sets))


def texts(seed=4):
    """A group of near copies larger than a list that is looked at two by two, texts that share a passage, small groups, odd texts."""
    r = random.Random(seed)
    base, passage, out = [r.choice(WORDS) for _ in range(60)], [r.choice(WORDS) for _ in range(40)], []
    for _ in range(150):
        t = list(base)
        for _ in range(r.randint(0, 3)):
            t[r.randrange(60)] = r.choice(WORDS)
        out.append(" ".join(t))
    out += [" ".join([r.choice(WORDS) for _ in range(r.randint(0, 12))] + passage[: r.randint(5, 40)]) for _ in range(100)]
    for _ in range(40):
        b = [r.choice(WORDS) for _ in range(r.randint(1, 300))]
        for _ in range(r.randint(1, 4)):
            t = list(b)
            for _ in range(r.randint(0, 4)):
                t.insert(r.randrange(len(t) + 1), r.choice(WORDS))
            out.append(" ".join(t).upper() if r.random() < 0.3 else "\t".join(t))
    out += ["", " \n ", None, "one two", "one two", "One two", "a b c d e"]
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("rows_of_block, grams", [(512, 1 << 18), (48, 3000)])
def test_join_against_all_pairs(spark, monkeypatch, rows_of_block, grams):
    monkeypatch.setattr(ngram_join, "ROWS", rows_of_block)
    monkeypatch.setattr(ngram_join, "GRAMS", grams)
    rows = texts()
    got = sorted(tuple(x) for x in ngram_join.ngram_join(spark, spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect())
    assert got == naive_join(rows, 4, 85)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_join_query_against_all_pairs(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(tuple(x) for x in queries.QUERIES["op11_ngram_join"](spark, SF).collect()) == naive_join(rows, 4, 85)


def test_filters_keep_every_link():
    """Sets around the threshold, in any order of rarity: what the filters pass is what all pairs give."""
    r = random.Random(2)
    for seed in range(12):
        counts = np.array([r.randint(0, 3) for _ in range(ngram_join.COUNTERS // 4096)] * 4096, np.uint16)
        pool = np.array(sorted({r.getrandbits(64) for _ in range(400)}), np.uint64)
        base = set(r.sample(range(len(pool)), r.randint(1, 120)))
        sets = []
        for _ in range(60):
            s = {x for x in base if r.random() > r.choice([0, 0.05, 0.1])} | set(r.sample(range(len(pool)), r.randint(0, 8)))
            sets.append(pool[sorted(s)] if s else pool[:1])
        cell = ngram_join.Cell(sets, np.ones(len(sets), np.int64), [np.array([7])] * len(sets), 85, counts)
        cell.join(7, np.arange(60), None)
        as_sets = [set(x.tolist()) for x in sets]
        want = [sum(100 * len(a & b) >= 85 * len(a | b) for j, b in enumerate(as_sets) if i != j) for i, a in enumerate(as_sets)]
        assert cell.links.tolist() == want


def test_counters_are_of_all_texts(spark):
    rows = [(i, f"a b c d x{i % 5} y{i % 7} z") for i in range(200)] + [(200, None), (201, "")]
    got = ngram_join.counters(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(40), 4)
    s = ngram_join.Shingler(4)
    want = np.zeros(ngram_join.COUNTERS, np.int64)
    for _, t in rows:
        np.add.at(want, s.set_of(t) >> ngram_join.SHIFT, 1)
    assert (got == want).all() and got.max() == 200


def test_join_of_odd_rows(spark):
    schema = "doc_id long, text string, n int, digest string, rep long, set string, bucket int, id string"
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A B C D e f"), (None, "a b c d e f"), (3, None), (3, None), (4, ""), (5, "x " * 50_000), (6, "x " * 60_000), (7, "q w e r"), (7, "a b c d e f")]
    df = spark.createDataFrame([(*r, 1, "k", 2, "k", 3, "k") for r in rows], schema)
    got = sorted((tuple(x) for x in ngram_join.ngram_join(spark, df, 4, 85).collect()), key=repr)
    by = {x[0]: x for x in got if x[0] not in (1, 3, 7, None)}
    assert len(got) == len(rows) and got.count((3, 0, 3, 0)) == 2 and by[4] == (4, 0, 4, 0)
    assert by[5] == (5, 1, 5, 1) and by[6] == (6, 1, 5, 1) and by[2][2] == 1
    assert [x[2] for x in got if x[0] == 1] == [1, 1] and [x[1:] for x in got if x[0] is None] == [(3, None, 0)]
    assert ngram_join.ngram_join(spark, df.limit(0), 4, 85).count() == 0


def naive_whitening(vectors, most=16):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(0)
    c = u - s / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1][:most], v[:, ::-1][:, :most]
    return n, ((n * x - s) ** 2).sum(1), (x - s / n) @ v / np.sqrt(e), e / np.trace(c.T @ c / n)


@pytest.mark.parametrize("parts", [1, 9, 150])
def test_whitening_against_one_decomposition(spark, parts):
    r = np.random.default_rng(3)
    a = r.normal(size=(300, 20)) @ np.diag(np.linspace(3, 0.2, 20)) + 5
    a = np.vstack([a, a[:40], np.repeat(a[:1], 200, axis=0)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)], "vec_id long, embedding array<float>").repartition(parts)
    got = whitening.whiten(spark, df).toPandas()
    stored = np.array([v for v in a], np.float32)
    n, deviation, white, explained = naive_whitening(stored)
    mine = got.pivot(index="vec_id", columns="component", values="whitened").sort_index().to_numpy()
    assert mine.shape == white.shape and np.abs(mine * np.sign((mine * white).sum(0)) - white).max() < 1e-8
    assert got.groupby("vec_id").deviation.first().sort_index().tolist() == deviation.tolist() and set(got.n) == {n}
    assert got.groupby("component").explained.first().to_numpy() == pytest.approx(explained, rel=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-10


def test_merging_loses_no_dimension():
    r = np.random.default_rng(1)
    x = r.integers(-500, 500, size=(64, 12))
    parts = [whitening.Summary.of(p) for p in (x[:1], x[1:3], x[3:40], x[40:])]
    total = parts[0].merged(parts[1]).merged(parts[2].merged(parts[3]))
    whole = whitening.Summary.of(x)
    assert total.n == 64 and (total.sums == x.sum(0)).all() and total.s == pytest.approx(whole.s) and len(parts[1].s) == 2
    cov = lambda m: (m.vt.T * m.s**2) @ m.vt
    assert np.allclose(cov(total), cov(whole))


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [2.0, 1.0]), (2, [2.0, 1.0]), (None, [0.0, 4.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (8, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "vec_id long, embedding array<float>, x string, component int")
    got = whitening.whiten(spark, df).collect()
    assert sorted(((r["vec_id"] or 0, r["component"], r["n"]) for r in got)) == [(0, 1, 3), (0, 2, 3), (1, 1, 3), (1, 2, 3), (2, 1, 3), (2, 1, 3), (2, 2, 3), (2, 2, 3)]
    assert whitening.whiten(spark, df.limit(0)).count() == 0 and whitening.whiten(spark, df.where("vec_id = 1")).count() == 0
    huge = whitening.Model(10**9, np.zeros(2, np.int64), np.ones(1), np.ones((1, 2)), np.ones(1))
    assert whitening.Model.deviation(huge.spread(np.array([[10**6, 1], [1, 2]]))) == [None, 5 * 10**18]


def h(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def tree_by_hand(leaves):
    """Root and the siblings of each leaf, with the side that they are on."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for i, p in enumerate(at):
            paths[i].append("" if p ^ 1 >= len(level) else ("L" if p & 1 else "R") + level[p ^ 1])
            at[i] = p >> 1
        level = [h(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0], paths


@pytest.mark.parametrize("height", [1, 2, 6])
def test_trees_of_every_size(spark, monkeypatch, height):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    groups = {f"={n:02d}": [h(f"{n}.{i}") for i in range(n)] for n in (1, 2, 3, 4, 5, 7, 8, 9, 17, 33)}
    rows = [(k, i, d, "x") for k, ds in groups.items() for i, d in enumerate(ds)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "key string, i int, digest string, more string").select("key", F.struct("i").alias("by"), "digest", "more")
    got = {(r["key"], r["by"]["i"]): r for r in merkle.manifest(spark, df).collect()}
    built = {k: tree_by_hand(v) for k, v in groups.items()}
    root, above = tree_by_hand([built[k][0] for k in sorted(groups)])
    for n, k in enumerate(sorted(groups)):
        for i, d in enumerate(groups[k]):
            r = got[k, i]
            assert (r["digest"], r["subroot"], r["root"], list(r["proof"]), r["more"]) == (d, built[k][0], root, built[k][1][i] + above[n], "x")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_manifest_equals_its_sql(spark):
    import duckdb

    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    got = queries.QUERIES["op13_merkle_manifest"](spark, SF)
    names = sorted(got.columns)
    want = c.execute(f"select {', '.join(names)} from ({queries.ORACLES['op13_merkle_manifest']})").fetchall()
    rows = sorted(tuple(r[n] for n in names) for r in got.collect())
    assert rows == sorted(want) and 0 < sum(not r[names.index("verified")] for r in rows) < len(rows) / 3


def test_manifest_of_odd_rows(spark):
    rows = [(1, "é", None, None, None), (1, "é", None, None, None), (None, None, None, None, 5), (2, "", "", "", 0), (3, "x" * 2_000_000, "en", "s", 2_000_000), (7, "a", "en", "s", None)] + [(i, "t", "en", "s", 1) for i in range(100, 140)]
    df = spark.createDataFrame([(*r, "k", 1, "d") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, key string, at int, digest string")
    got = merkle.verified_manifest(spark, df).collect()
    assert len(got) == len(rows) and len({r["root"] for r in got}) == 1 and len({r["subroot"] for r in got}) == 3
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaves = sorted(h(*map(field, (i, s, g, n, t))) for i, t, g, s, n in rows)
    assert sorted(r["leaf"] for r in got) == leaves
    for r in got:
        known = next(x for x in rows if x[0] == r["doc_id"])
        changed = r["doc_id"] is not None and known[4] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
        assert r["verified"] == (not changed) == (r["folded_root"] == r["root"])
    assert merkle.verified_manifest(spark, df.limit(0)).count() == 0
