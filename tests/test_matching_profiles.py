from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from skylattice.operators import graph, matching, profiles
from skylattice.plans import intervals, selection


def greedy(left, right):
    unused, out = sorted(right, key=lambda x: (x[2], x[0])), []
    for name, need, _ in sorted(left, key=lambda x: (x[2], x[0])):
        hit = next((x for x in unused if set(need or []) <= set(x[1] or [])), None)
        if hit:
            unused.remove(hit)
            out.append((name, hit[0]))
    return sorted(out)


@pytest.mark.parametrize("n, m, each", [(40, 25, 7), (30, 60, 1000)])
def test_one_use_match_equals_the_loop(spark, n, m, each):
    r = random.Random(n)
    some = lambda: r.choice([None, [], *[r.sample(["H1", "L1", "V1"], r.randint(1, 3)) for _ in range(6)]])
    left = [(f"g{i}", some(), r.randint(0, 9)) for i in range(n)]
    right = [(i, some(), r.randint(0, 9)) for i in range(m)]
    a = spark.createDataFrame(left, "name string, need array<string>, o int")
    b = spark.createDataFrame(right, "name long, has array<string>, o int")
    got = matching.one_use_match(spark, a, b, F.col("o"), F.col("o"), each=each)
    assert sorted(tuple(x) for x in got.collect()) == greedy(left, right)
    assert matching.one_use_match(spark, a.limit(0), b, F.col("o"), F.col("o")).count() == 0
    assert matching.one_use_match(spark, a, b.limit(0), F.col("o"), F.col("o")).count() == 0
    with pytest.raises(ValueError):
        matching.one_use_match(spark, a.unionByName(a), b, F.col("o"), F.col("o"))
    with pytest.raises(ValueError):
        matching.one_use_match(spark, a, b, F.col("o"), F.col("o"), classes=1)


def balanced(groups, fractions):
    total = {k: sum(g.get(k, 0) for g in groups.values()) for k in {k for g in groups.values() for k in g}}
    have = {s: dict.fromkeys(total, 0) for s in fractions}
    out = {}
    for name in sorted(groups, key=lambda n: (-sum(groups[n].values()), n)):
        def off(s, own):
            return sum(((have[s][k] + own.get(k, 0) - fractions[s] * total[k]) / max(1.0, fractions[s] * total[k])) ** 2 for k in total)

        out[name] = min(sorted(fractions), key=lambda s: round(off(s, groups[name]) - off(s, {}), 12))
        for k, v in groups[name].items():
            have[out[name]][k] += v
    return out


@pytest.mark.parametrize("each", [5, 1000])
def test_balanced_split_equals_the_loop(spark, each):
    r = random.Random(each)
    groups = {f"g{i:02d}": {k: r.randint(1, 9) for k in "xyz" if r.random() < 0.6} or {"x": 1} for i in range(33)}
    fractions = {"train": 0.6, "val": 0.25, "test": 0.15}
    rows = [(n, k, v) for n, g in groups.items() for k, v in g.items()] + [(None, "x", 3), ("g00", "x", None)]
    df = spark.createDataFrame(rows, "name string, label string, n long")
    got = {x["name"]: x["split"] for x in matching.balanced_split(spark, df, fractions, each=each).collect()}
    assert got == balanced(groups, fractions)
    assert matching.balanced_split(spark, df.limit(0), fractions).count() == 0


def allocation(sizes, scales):
    """The rule, one row at a time."""
    have, out = dict.fromkeys(sizes, 0), []
    for s in scales:
        while sum(have.values()) < s:
            k = max((k for k in sizes if have[k] < sizes[k]), key=lambda k: (s * sizes[k] / sum(sizes.values()) - have[k], -have[k], k))
            have[k] += 1
        out.append(dict(have))
    return {k: [o[k] for o in out] for k in sizes}


@pytest.mark.parametrize("seed", range(6))
def test_allocated_strata_equal_the_loop(spark, seed):
    r = random.Random(seed)
    sizes = {(f"f{i % 4}", f"b{i // 4}"): r.choice([1, 1, 2, 3, 40, 200]) for i in range(r.choice([1, 3, 17]))}
    total = sum(sizes.values())
    scales = sorted({r.randint(1, total) for _ in range(3)} | {total})
    df = spark.createDataFrame([(*k, n) for k, n in sizes.items()], "family string, bin string, n long")
    got = {(x["family"], x["bin"]): x["counts"] for x in selection.allocated_strata(df, ["family", "bin"], scales).collect()}
    assert got == allocation(sizes, scales)
    with pytest.raises(ValueError):
        selection.allocated_strata(df, ["family", "bin"], [total + 1])


def test_nested_scales_are_exact_and_nested(spark):
    r = random.Random(1)
    rows = [(i, r.choice(["a", "a", "a", None])) for i in range(60)]
    df = spark.createDataFrame(rows, "i long, family string")
    got = {}
    for x in selection.nested_scales(df, ["family"], "i", 7, [9, 30, 31]).collect():
        got.setdefault(x["scale"], set()).add(x["i"])
    assert [len(got[s]) for s in (9, 30, 31)] == [9, 30, 31] and got[9] < got[30] < got[31]
    first = sorted((i for i, f in rows if f == "a"), key=lambda i: hashlib.sha256(f"7:{i}".encode()).hexdigest())
    mine = got[30] & set(first)
    assert mine == set(first[: len(mine)])


def test_cover_in_small_batches_is_the_same(spark):
    r = random.Random(8)
    rows = [(f"f{i:02d}", label, r.randint(1, 6), 1 + i % 3) for i in range(40) for label in "uvwxyz" if r.random() < 0.4]
    df = spark.createDataFrame(rows, "name string, label string, n long, cost int")
    whole = [tuple(x) for x in graph.greedy_cover(spark, df, 30, 40).orderBy("step").collect()]
    small = [tuple(x) for x in graph.greedy_cover(spark, df, 30, 40, batch=3).orderBy("step").collect()]
    assert whole == small and len(whole) > 5


@pytest.mark.parametrize("least", [1, 3])
def test_runs_of_pieces_equal_those_of_rows(spark, least):
    r = random.Random(least)
    pieces, values = [], []
    for key in ("H1", "L1", None):
        at = 5
        for _ in range(12):
            at += r.choice([0, 0, 0, 2])
            piece = [r.choice([None, 0.1, 0.6, 0.7, 0.9, 0.9]) for _ in range(r.choice([0, 1, 2, 9]))]
            pieces.append((key, at, piece))
            values += [(key, at + i, v) for i, v in enumerate(piece)]
            at += len(piece)
    r.shuffle(pieces)
    df = spark.createDataFrame([*pieces, ("H1", None, [1.0])], "ifo string, at long, v array<double>")
    got = profiles.profile_runs(df, ["ifo"], "at", "v", 0.5, least)
    want = intervals.threshold_runs(spark.createDataFrame(values, "ifo string, p long, v double"), ["ifo"], "p", "v", 0.5, least).select(*got.columns)
    order = lambda df: sorted((tuple(x) for x in df.collect()), key=repr)
    assert order(got) == order(want) and got.count() > 5
    one = spark.createDataFrame([("H1", 0, [1.0, float("nan"), 1.0]), ("H1", 3, [2.0])], "ifo string, at long, v array<double>")
    assert order(profiles.profile_runs(one, ["ifo"], "at", "v", 0.5)) == [("H1", 0, 0, 1, 0, 1.0), ("H1", 2, 3, 2, 3, 2.0)]
    assert order(profiles.profile_runs(one.drop("ifo"), [], "at", "v", 0.5)) == [(0, 0, 1, 0, 1.0), (2, 3, 2, 3, 2.0)]
    assert profiles.profile_runs(one.limit(0), ["ifo"], "at", "v", 0.5).count() == 0
    with pytest.raises(Exception, match="overlaps"):
        profiles.profile_runs(one.withColumn("at", F.lit(0)), ["ifo"], "at", "v", 0.5).collect()
