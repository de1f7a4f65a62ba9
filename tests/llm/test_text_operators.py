from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skylattice.llm import bpe_codec, html_extract, language_id, line_dedup, mixing, near_dedup, pretokenize, token_counts, toxicity
from skylattice.llm.queries import VOCABULARY

PATH = public_tokenizers.path(VOCABULARY)
ODD = "doc_id long, text string, lang string, source string, n_chars long, key string, pos int, v long, n int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and blank texts, ties, repeated rows, a very long text, columns with clashing names."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", None, 4), (4, "one two three", "en", "a", 13), (4, "one two three", "en", "a", 13),
        (None, "a line that is quite long enough\nx", "en", "b", 10), (5, long, "de", "b", len(long)), (6, long, "de", "b", len(long)), (7, "12345 %%%", "fr", "c", 9), (8, "One  TWO\tthree", "en", "a", 5),
    ]
    return spark.createDataFrame([(*r, "k", 1, 2, 3) for r in rows], ODD)


def texts(n=300, seed=1):
    r = random.Random(seed)
    parts = [*"abstmdrvel'' \n\t  .!?129éÉß中😀 　\r\x1c\x85", "'re", "'ll", "'ve", "<|endoftext|>", " the", "ing "]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 80))) for _ in range(n)]


def test_encoding_and_counts_equal_the_library(spark):
    t = Tokenizer.from_file(PATH)
    rows = texts() + [None]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    ids = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in bpe_codec.encode_documents(spark, df, PATH).collect()}
    counts = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in token_counts.token_counts(spark, df, PATH).collect()}
    decoded = {r["doc_id"]: r["decoded_sha256"] for r in bpe_codec.round_trip(spark, df, PATH).collect()}
    for i, x in enumerate(rows):
        want = t.encode(x or "", add_special_tokens=False).ids
        assert ids[i] == want and counts[i] == (len((x or "").encode()), len(want)), repr(x)
        assert decoded[i] == hashlib.sha256(t.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_long_texts_are_split_like_short_ones():
    whole = "".join(texts(200, 5))
    data, a, b, _ = pretokenize.pieces([whole])
    assert [data[x:y] for x, y in zip(a, b)] == [p for found in pretokenize.pieces_of_long(whole, 501) for p in found]


def test_a_small_table_of_states_gives_the_same_counts():
    v = bpe_codec.vocabulary(open(PATH, "rb").read())
    small, large = token_counts.CountingTransducer(v, 50), token_counts.CountingTransducer(v)
    rows = texts(60, 9)
    got = [token_counts.count_tokens(small, [x])[0] for x in rows]
    assert got == token_counts.count_tokens(large, rows)


def naive_lines(rows, least=20, docs=3):
    keys, strip = {}, " \t\n\x0b\x0c\r"
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t in rows:
        for line in (t or "").split("\n"):
            keys.setdefault(line.strip(strip).translate(low), set()).add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(k := x.strip(strip).translate(low)) >= least and len(keys[k]) >= docs and i < max(keys[k]))]
        out[i] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def test_line_dedup_against_naive(spark):
    r = random.Random(4)
    pool = [f"This line is number {i} of the pool é" for i in range(12)] + ["short", "", "  This LINE is number 3 of the pool é\t"]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(1, 150)))) for i in range(40)] + [(100, None), (101, "")]
    got = line_dedup.line_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert {x["doc_id"]: (x["n_lines"], x["n_dropped"], x["kept_sha256"]) for x in got.collect()} == naive_lines(rows)


def naive_groups(rows, words, percent):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0d]+", (t or "").translate(low)) if x]
        sets[i] = {tuple(w[j : j + words]) for j in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("words", [4, 5])
def test_near_duplicates_against_all_pairs(spark, words):
    r = random.Random(8)
    vocab = [f"w{i}" for i in range(400)]
    passage = [r.choice(vocab) for _ in range(40)]
    rows, n = [], 0

    def add(w):
        nonlocal n
        rows.append((n, " ".join(w)))
        n += 1

    for _ in range(60):
        add([r.choice(vocab) for _ in range(r.randint(1, 90))])
    base = [r.choice(vocab) for _ in range(120)]
    for _ in range(70):  # a group of near copies, longer than a list that is expanded
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = r.choice(vocab)
        add(w)
    for _ in range(50):  # texts that are little but a common passage
        add(passage + [r.choice(vocab) for _ in range(r.randint(0, 12))])
    for _ in range(10):
        add(base)
    add(["A", "b"])
    add(["a", "B"])
    rows += [(n, None), (n + 1, ""), (n + 2, " \n")]
    got = near_dedup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), words, 80)
    want = naive_groups(rows, words, 80)
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got.collect()} == want


def test_texts_that_hold_a_member_of_a_large_group_whole(spark):
    """The larger set of a pair, outside the main component of its long lists, has only 0.8 of its shingles there."""
    r = random.Random(3)
    own = iter(f"o{i}" for i in range(100_000))
    base = [f"h{i}" for i in range(103)]
    rows = [(i, " ".join([*base[:-1], f"end{i}"])) for i in range(40)]
    for i in range(40):
        rows.append((100 + i, " ".join([*base[:-1], f"end{r.randrange(40)}", *(next(own) for _ in range(24))])))
    got = near_dedup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), 4, 80)
    want = naive_groups(rows, 4, 80)
    assert set(want.values()) == {(100, 0), (124, 0)}
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got.collect()} == want


def check_groups(spark, rows, words=4, percent=80):
    got = near_dedup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), words, percent)
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got.collect()} == naive_groups(rows, words, percent)


@pytest.mark.parametrize("seed", [0, 1])
def test_a_common_passage_with_words_of_their_own(spark, seed):
    """161 texts around a passage of 300 shingles: 100 of them are linked with one short text only."""
    r = random.Random(seed)
    own = (f"{seed}o{i}" for i in range(100_000))
    passage = [f"p{i}" for i in range(303)]
    sizes = [12] + [r.randint(14, 20) for _ in range(60)] + [r.choice((62, 63)) for _ in range(100)]
    if seed:
        r.shuffle(sizes)
    check_groups(spark, [(i, " ".join([*passage, *(next(own) for _ in range(n))])) for i, n in enumerate(sizes)])


def test_union_sketches_bound_what_is_shared():
    r = np.random.default_rng(4)
    frequent = np.sort(r.integers(0, 1 << 62, 40).astype(np.uint64))
    rank = r.permutation(40).astype(np.int64)
    for _ in range(200):
        base = np.unique(np.concatenate([r.integers(0, 1 << 62, r.integers(1, 60)).astype(np.uint64), r.choice(frequent, r.integers(0, 30))]))
        other = np.unique(np.concatenate([base[r.random(len(base)) < 0.9], r.integers(0, 1 << 62, 3).astype(np.uint64)]))
        common = len(np.intersect1d(base, other))
        x, y = (near_dedup.sketch_of(s, 80, frequent, rank) for s in (base, other))
        some, most = near_dedup.most_shared(x, len(base), y, len(other), frequent, rank)
        assert some <= common <= most
        if near_dedup.similar(base, other, 80):
            assert some >= 1


def test_rows_of_one_id_with_different_texts(spark):
    rows = [(1, "a b c d e f"), (1, "u v w x y z"), (2, "u v w x y z"), (3, "a b c d e f"), (1, None)]
    got = near_dedup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()
    assert len(got) == 5 and {x["component_id"] for x in got if x["doc_id"] == 1} == {1} and sorted(x["component_id"] for x in got if x["doc_id"] > 1) in ([1, 2], [1, 3])


def test_short_texts_with_a_frequent_phrase(spark):
    """Sets of a few shingles, half of them in long lists, share few values with their copies."""
    rows = [(i, f"this phrase is quite common x{i} y{i}") for i in range(60)]
    rows += [(100 + i, f"this phrase is quite common x{i} y{i} z{i}") for i in range(0, 60, 7)]
    rows += [(200 + i, " ".join([*(f"p{k}" for k in range(9)), *(f"{i}q{k}" for k in range(4))])) for i in range(60)]
    rows += [(300 + i, " ".join([*(f"p{k}" for k in range(9)), *(f"{i}q{k}" for k in range(6))])) for i in range(0, 60, 7)]
    for words, percent in ((4, 80), (5, 60)):
        got = near_dedup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), words, percent)
        assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got.collect()} == naive_groups(rows, words, percent)


def test_lists_and_pairs_in_rounds(spark, monkeypatch):
    """No step of a table that is large for its rounds makes all lists or judges all pairs at once."""
    r = random.Random(12)
    rows = []
    for g in range(30):  # near copies in groups
        base = [f"g{g}w{k}" for k in range(60)]
        for _ in range(4):
            w = list(base)
            w[r.randrange(60)] = f"x{len(rows)}"
            rows.append((len(rows), " ".join(w)))
    base = [f"b{k}" for k in range(150)]
    for _ in range(60):  # a group longer than a list that is expanded
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(150)] = f"x{len(rows)}y{r.random()}"
        rows.append((len(rows), " ".join(w)))
    phrase = [f"p{k}" for k in range(30)]
    for _ in range(50):  # linked with nothing, in long lists
        rows.append((len(rows), " ".join([*phrase, *(f"z{len(rows)}o{k}" for k in range(12))])))
    for name, most in (("VALUES", 900), ("MEETING", 200), ("SKETCHED", 40), ("CONFIRMED", 40), ("BLOCKED", 30)):
        monkeypatch.setattr(near_dedup, name, most, raising=False)
    written, plain = {}, near_dedup.checkpoint

    def watched(session, df):
        out = plain(session, df)
        written.setdefault(" ".join(df.columns), []).append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "checkpoint", watched)
    check_groups(spark, rows)
    for made in ("rep n v c", "v rep n c", "a b"):
        if sizes := [x for x in written.get(made, []) if x]:
            assert len(sizes) > 2 and max(sizes) < 0.75 * sum(sizes), (made, sizes)
    assert "a b shared" in written


def test_mixing_meets_its_targets(spark):
    r = random.Random(2)
    rows = [(i, " ".join("x" * r.randint(1, 9) for _ in range(r.choice([3, 30, 300]))), r.choice(["a", "b", "c", "d", None])) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a, b = (sorted(tuple(x) for x in mixing.mix(spark, d).select("doc_id", "size", "source_size", "target", "taken", F.coalesce("source", F.lit("~"))).collect()) for d in (df, df.repartition(7)))
    assert a == b
    sizes = {i: len(t.split()) for i, t, _ in rows}
    taken, target = {}, {}
    for i, size, _, t, k, s in a:
        assert size == sizes[i] and k % size == 0 and k <= 3 * size
        taken[s], target[s] = taken.get(s, 0) + k, t
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] for s in target)


def naive_targets(sizes, most=3.0):
    """Fill by weight; sources above `most` times their size stop there, and the rest is shared again."""
    order = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    full = set()
    while True:
        rest, shares = sum(sizes.values()) - most * sum(sizes[s] for s in full), sum(weight[s] for s in order if s not in full)
        over = {s for s in order if s not in full and rest * weight[s] / shares > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else rest * weight[s] / shares for s in order}
        full |= over


def test_targets_against_filling_by_hand(spark, monkeypatch):
    r = random.Random(3)
    cases = [{"a": 10, "b": 90, None: 0}, {"a": 100, "b": 1, "c": 1000}, {f"s{i}é" if i % 3 else chr(0xFFFF - i) + "x": int(10 ** r.uniform(0, 4)) for i in range(120)} | {None: 17, "": 3}, {}]
    for k, sizes in enumerate(cases):
        monkeypatch.setattr(mixing, "BROADCAST_ROWS", 50_000 if k % 2 else 20)
        df = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, size long, n long")
        got = {x["source"]: x["target"] for x in mixing.targets(spark, df).collect()}
        assert got == {s: pytest.approx(v) for s, v in naive_targets(sizes).items()}


def test_mixing_against_one_flight_of_each_source(spark, monkeypatch):
    """Blocks and levels keep the totals that one flight over a whole source keeps, for rows that are alike too."""
    monkeypatch.setattr(mixing, "BLOCK", 40)
    monkeypatch.setattr(mixing, "FAN", 3)
    r = random.Random(4)
    rows = [(None if i % 3 == 0 else i, "x " * r.randint(1, 60), r.choice("abc")) for i in range(900)] + [(None, "the same row " * 9, "b")] * 500 + [(5, "y y", "c")] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a, b = (sorted((x["doc_id"] or -1, x["source"], x["size"], x["copies"], x["taken"]) for x in mixing.mix(spark, d).collect()) for d in (df, df.repartition(7)))
    assert a == b and len(a) == len(rows)
    sizes = {s: [len(t.split()) for _, t, k in rows if k == s] for s in "abc"}
    for s, target in naive_targets({s: sum(v) for s, v in sizes.items()}).items():
        own = [x for x in a if x[1] == s]
        whole = int(target / sum(sizes[s]) + 1e-9)
        assert {x[3] - whole for x in own} <= {0, 1} and all(x[4] == x[2] * x[3] for x in own)
        flight = mixing.fly([target / sum(sizes[s]) - whole] * len(own), [float(v) for v in sizes[s]], [r.random() for _ in own], True)
        naive = whole * sum(sizes[s]) + sum(v for v, p in zip(sizes[s], flight) if p > 0.5)
        assert abs(sum(x[4] for x in own) - target) <= 60 and abs(naive - target) <= 60


def test_cube_keeps_totals():
    r = random.Random(3)
    x = [float(r.randint(1, 500)) for _ in range(400)]
    p = mixing.fly([0.37] * 400, x, [r.random() for _ in x], True)
    assert set(p) <= {0.0, 1.0} and abs(sum(p) - 148) <= 2 and abs(sum(a * b for a, b in zip(p, x)) - 0.37 * sum(x)) <= 500


def test_the_landing_is_small():
    """A few long documents among many short ones: no draw misses by more than a median document."""
    r = random.Random(5)
    x = [3364.0, 1900.0, 1200.0] + [float(r.randint(15, 600)) for _ in range(47)]
    off, taken = [], [0.0] * len(x)
    for k in range(200):
        d = random.Random(k)
        p = mixing.fly([0.5] * len(x), x, [d.random() for _ in x], True)
        assert set(p) <= {0.0, 1.0}
        off.append(abs(sum(a * b for a, b in zip(p, x)) - 0.5 * sum(x)))
        taken = [a + b / 200 for a, b in zip(taken, p)]
    assert max(off) <= sorted(x)[25] and sum(off) / 200 <= 20
    assert 0.38 < taken[0] < 0.62 and mixing.fly([], [], [], True) == []
    assert mixing.fly([0.5] * 4, [0.0, 0.0, 7.0, 0.0], [0.1, 0.9, 0.4, 0.6], True)[2] in (0.0, 1.0)


def test_gradients_of_the_network():
    net = language_id.Network(["a", "b", "c"], np.random.default_rng(0))
    for k in net.names:
        setattr(net, k, getattr(net, k).astype(np.float64))
    rows = ["hello you ", "wörld\n", "x"]
    x = np.full((12, 3), language_id.NONE)
    for i, t in enumerate(rows):
        b = t.encode()
        x[: len(b), i] = list(b)
    y, both, inside = np.array([0, 1, 2]), np.stack([x, x[::-1]]), x != language_id.NONE
    _, grads = net.gradients(both, inside, y)
    for name, g in grads.items():
        w = getattr(net, name)
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, e = w[at], 1e-4
        w[at] = old + e
        up = net.gradients(both, inside, y)[0]
        w[at] = old - e
        down = net.gradients(both, inside, y)[0]
        w[at] = old
        assert g[at] == pytest.approx((up - down) / (2 * e), rel=1e-3)


def whole_forward(net, text):
    """Position by position over a whole document, without windows."""
    data, h = list(text.encode()), net.u.shape[2]
    gate = lambda x: 0.5 * x / (1 + np.abs(x)) + 0.5
    states = []
    for d, order in ((0, data), (1, data[::-1])):
        s, out = np.zeros(h), []
        for b in order:
            x, g = net.e[d, :, b], net.u[d] @ s + net.b[d, :, 0]
            r, z = gate(x[:h] + g[:h]), gate(x[h : 2 * h] + g[h : 2 * h])
            c = x[2 * h :] + r * g[2 * h :]
            c = c / (1 + np.abs(c))
            s = c + z * (s - c)
            out.append(s)
        states.append(out if d == 0 else out[::-1])
    p = [net.v[0] @ a + net.v[1] @ b + net.c[:, 0] for a, b in zip(*states)]
    p = [np.exp(v - v.max()) for v in p]
    return np.mean([v / v.sum() for v in p], axis=0)


LANGUAGES = {"en": "the and of to was with from this thing", "de": "der und die nicht ein über für schön auch", "fr": "le la et être avec pour où français déjà"}


def test_windows_equal_reading_the_whole_document():
    r = random.Random(6)
    net = language_id.Network(sorted(LANGUAGES), np.random.default_rng(2))
    chunks = [(" ".join(r.choice(LANGUAGES[k].split()) for _ in range(14)).encode(), i) for i, k in enumerate(net.languages) for _ in range(60)]
    net.learn([c for c, _ in chunks], np.array([i for _, i in chunks]), steps=120)
    texts = ["a", "the and" * 1, "x" * 700, " ".join(r.choice(LANGUAGES["fr"].split()) for _ in range(400)), "\n".join(r.choice(LANGUAGES[r.choice(net.languages)].split()) for _ in range(200)), "über" * 32 + "\t"]
    got = net.documents([t.encode() for t in texts])
    want = np.stack([whole_forward(net, t) for t in texts])
    assert np.abs(got - want).max() < 1e-4 and (got.argmax(1) == want.argmax(1)).all()
    alone = np.concatenate([net.documents([t.encode()]) for t in texts])
    assert np.abs(got - alone).max() < 1e-5  # whatever else is read beside a text


def test_a_text_is_read_in_slices(monkeypatch):
    net = language_id.Network(["a", "b"], np.random.default_rng(2))
    data = [random.Random(1).randbytes(70_000), b"", b"abc"]
    whole = net.documents(data)
    monkeypatch.setattr(language_id, "AT_ONCE", 64 * language_id.WINDOW * 2)
    assert np.abs(net.documents(data) - whole).max() < 1e-5 and not whole[1].any()


def test_letters_are_of_category_l():
    assert [language_id.has_letter(t) for t in ("½ ²", "Ⅷ ①", "½ b", "_1", "", None, "日", "é", "٣")] == [False, False, True, False, False, False, True, True, False]


def test_what_is_learned_from_is_bounded(spark):
    assert all(len(p) <= language_id.CHUNK for p in language_id.chunks_of("x" * 100_000)) and len(language_id.chunks_of("é" * 100_000)) == language_id.CHUNKS
    assert language_id.chunks_of("ab") == [b"ab"] and language_id.chunks_of("") == []
    rows = [(None, "the same text", "en")] * 900 + [(7, "der andere", "de")] * 900 + [(8, "x" * 200_000, "fr")]
    net = language_id.train(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert net.languages == ["de", "en", "fr"]


def test_language_id_on_held_out_rows(spark):
    r = random.Random(1)
    words = LANGUAGES
    rows = [(i, " ".join(r.choice(words[k].split()) for _ in range(30)), k) for i, k in enumerate(r.choice(list(words)) for _ in range(240))] + [(900, None, "en"), (901, "½ 2 !", None)]
    got = {x["doc_id"]: x for x in language_id.language_id(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for i, _, k in rows[:-2]:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= got[i]["score"] <= 1
    out = [got[i]["lang_pred"] == k for i, _, k in rows[:-2] if got[i]["held_out"]]
    assert np.mean(out) > 0.95 and got[900]["lang_pred"] == got[901]["lang_pred"] == "und"


def test_a_language_of_blank_texts_does_not_stop_learning(spark):
    r = random.Random(1)
    words = {"en": "the and of to was with from this thing", "de": "der und die nicht ein über für schön auch"}
    rows = [(i, " ".join(r.choice(words[k].split()) for _ in range(30)), k) for i, k in enumerate(r.choice(list(words)) for _ in range(120))]
    rows += [(1000 + i, " \u3000\n" if i % 2 else "", "zxx") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = language_id.train(spark, df)
    got = {x["doc_id"]: x["lang_pred"] for x in language_id.language_id(spark, df, net=net).collect()}
    assert net.languages == ["de", "en"] and np.mean([got[i] == k for i, _, k in rows[:120]]) > 0.95


def test_toxicity_on_held_out_rows(spark):
    r = random.Random(1)
    plain = [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(900):
        bad = r.random() < 0.25
        rows.append((i, " ".join([r.choice(plain) for _ in range(25)] + (r.sample(["vile", "scum", "trash"], 2) if bad else []))))
        labels.append((i, 1, int(bad)))
    docs, lab = spark.createDataFrame(rows + [(5000, None), (5001, "")], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in toxicity.toxicity_scores(spark, docs, lab).collect()}
    hits = [got[i]["predicted"] == y for i, _, y in labels if got[i]["held_out"]]
    assert np.mean(hits) > 0.97 and got[5000]["predicted"] == got[5001]["predicted"] == 0
    assert all(x["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, x in got.items())


def naive_ftrl(rows, alpha, beta, l1, l2, passes):
    """The published update, one feature at a time."""
    from math import exp, sqrt

    z, n, bz, bn = {}, {}, 0.0, 0.0

    def weight(i):
        return 0.0 if abs(z.get(i, 0.0)) <= l1 else -(z[i] - (l1 if z[i] > 0 else -l1)) / ((beta + sqrt(n[i])) / alpha + l2)

    def bias():
        return -bz / ((beta + sqrt(bn)) / alpha)

    for _ in range(passes):
        for x, y in rows:
            w, b = {i: weight(i) for i in x}, bias()
            g = 1 / (1 + exp(-(sum(w.values()) + b))) - y
            for i in x:
                z[i] = z.get(i, 0.0) + g - (sqrt(n.get(i, 0.0) + g * g) - sqrt(n.get(i, 0.0))) / alpha * w[i]
                n[i] = n.get(i, 0.0) + g * g
            bz += g - (sqrt(bn + g * g) - sqrt(bn)) / alpha * b
            bn += g * g
    return {i: weight(i) for i in z if weight(i)}, bias()


def naive_features(text, bits=toxicity.BITS):
    f = toxicity.Features(bits)
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    out = {int(f.of([w])[0][0]) for w in words}
    for gap in (1, 2, 3):
        for a, b in zip(words, words[gap:]):
            pair = f.words(f"{a} {b}")
            out.add(int(f._mix(pair[:1] * np.uint64(0xD6E8FEB86659FD93) + pair[1:] + np.uint64(gap))[0]))
    return out


def test_toxicity_against_the_published_update(spark):
    r = random.Random(7)
    rows = [(i, " ".join(r.choice(["vile", "scum", "kind", "day", "sun", "tree"]) for _ in range(r.randint(0, 12)))) for i in range(150)]
    labels = [(i, int("vile scum" in t)) for i, t in rows]
    docs, lab = spark.createDataFrame(rows + rows[:40], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    at, w, bias = toxicity.train(spark, docs, lab)
    order = [x["id"] for x in spark.range(150).select("id", F.xxhash64("id").alias("h")).orderBy("h").collect()]
    learned = [(naive_features(rows[i][1]), labels[i][1]) for i in order if zlib.crc32(str(i).encode()) % 5]
    want, want_bias = naive_ftrl(learned, toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2, toxicity.PASSES)
    assert dict(zip(at.tolist(), w.tolist())) == {k: pytest.approx(v) for k, v in want.items()} and bias == pytest.approx(want_bias)
    got = {x["doc_id"]: x["score"] for x in toxicity.toxicity_scores(spark, docs, lab).collect()}
    for i, t in rows:
        assert got[i] == pytest.approx(1 / (1 + np.exp(-sum(want.get(k, 0.0) for k in naive_features(t)) - want_bias)))
    nothing = toxicity.toxicity_scores(spark, docs, lab.limit(0)).collect()
    assert {(round(x["score"], 4), x["predicted"]) for x in nothing} == {(0.2689, 0)}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a>Home</a></li></ul></nav><div class="ad">Buy {n}</div>
<article><header><h1>Title &amp; {n}</h1></header><p>One<b> two</b> &nbsp; {n}<br>three<p>Next &lt;{n}&gt;<ul><li>a{n}<li>b{n}</ul><div class="share">Share</div><div class="comments"><p>No</p></div><script>var a="</p>";</script></article>
<div class="x7">Again and again</div><footer>&copy; x</footer></body>"""


def test_main_text(spark):
    rows = [(n, "http://A.example/p", PAGE.format(n=n)) for n in range(15)] + [(100, None, None), (101, "x", ""), (102, "http://b/", "<p>Alone<div class='box'>Here</div>"), (103, "http://b/", "<nav>only")]
    got = {x["page_id"]: x for x in html_extract.main_text(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for n in range(15):
        want = f"Title & {n}\n\nOne two {n} three\n\nNext <{n}>\n\na{n}\n\nb{n}"
        assert (got[n]["text"], got[n]["n_chars"]) == (want, len(want))
    assert [got[i]["text"] for i in (100, 101, 102, 103)] == ["", "", "Alone\n\nHere", ""]


def test_names_of_headings_paragraphs_and_sections_are_free(spark):
    page = '<article><h2 id="related-work">Work</h2><p class="notice">Note</p><section id="search-algorithms"><h3 id="legal_status">Law</h3><p>Text</p></section></article>'
    got = html_extract.main_text(spark, spark.createDataFrame([(1, "http://d/", page)], "page_id long, url string, html string")).collect()
    assert got[0]["text"] == "Work\n\nNote\n\nLaw\n\nText"


def main_texts(spark, rows, **more):
    got = html_extract.main_text(spark, spark.createDataFrame(rows, "page_id long, url string, html string"), **more).collect()
    return {x["page_id"]: x["text"] for x in got}


LONG = "This sentence is running text of more than ten words, number {n}."


def test_pages_without_article_depend_on_the_tree(spark):
    """Nothing here is named; what comes back on the pages of a host goes, below ten pages too."""
    page = "<body><div class=a1><span>Home</span> <span>News</span></div><div class=b2><h1>Title {n}</h1><p>" + LONG + "</p><div class=c3>Read more of this</div></div><div class=d4>All rights kept</div></body>"
    rows = [(n, f"http://one.example/{n}", page.format(n=n)) for n in range(8)]
    want = {n: f"Title {n}\n\n{LONG.format(n=n)}" for n in range(8)}
    assert main_texts(spark, rows) == want
    assert main_texts(spark, rows, broadcast_rows=1) == want  # the rest of the tree is joined
    assert html_extract.extract(rows[0][2], {}) != want[0]  # an empty tree keeps all of it


def test_copies_of_a_page_count_once(spark):
    page = "<body><div class=b2><h1>Title</h1><ul><li>A point of the list</ul><p>" + LONG + "</p></div></body>"
    other = "<body><div class=b2><h1>Other {n}</h1><p>" + LONG + "</p></div></body>"
    rows = [(n, "http://two.example/", page) for n in range(30)] + [(100 + n, "http://two.example/", other.format(n=n)) for n in range(9)]
    got = main_texts(spark, rows)
    assert all(got[n] == f"Title\n\nA point of the list\n\n{LONG}" for n in range(30))


def naive_tree(pages):
    """Entropies of one host by counting."""
    from collections import Counter
    from math import log

    seen, have = Counter(), Counter()
    for html in {html_extract.features(h)[0]: h for h in pages}.values():
        order, blocks = html_extract.parse(html)
        seen.update({(b.key, 0, t) for b, t in blocks} | {(x.key, 1, " ".join(x.children)) for x in order})
        have.update({x.key for x in order})
    out = {}
    for node, m in have.items():
        part = []
        for kind in (0, 1):
            c = [v for (n, k, _), v in seen.items() if n == node and k == kind]
            part.append((m * (1 - sum(v * log(v) for v in c) / (sum(c) * log(m))) + html_extract.EVIDENCE) / (m + html_extract.EVIDENCE) if c and m > 1 else None)
        if any(p is not None and p < 0.95 for p in part):
            out[node] = tuple(part)
    return out


def test_the_tree_equals_counting(spark):
    r = random.Random(5)
    pages = ["<body>" + "".join(f"<{t} class={c}>" + r.choice(["x", "y", f"z{r.random()}"]) + f"</{t}>" for t, c in r.choices([("div", "a"), ("p", "b"), ("ul", "c"), ("div", "d3")], k=r.randint(1, 6))) for _ in range(60)]
    df = spark.createDataFrame([(i, "http://h.example/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    got = {x["node"]: (x["content"], x["style"]) for x in html_extract.style_tree(spark, df).collect()}
    want = naive_tree(pages)
    assert got.keys() == want.keys()
    for k, (a, b) in want.items():
        assert got[k] == (a and pytest.approx(a), b and pytest.approx(b))


def test_names_are_outvoted_by_text(spark):
    text = "".join(f"<p>{LONG}</p>" for _ in range(4))
    plain = "\n\n".join([LONG] * 4)
    cases = [
        f"<form><nav><a>Home</a></nav><article>{text}</article><div class=ad>Buy</div></form>",
        f"<form id=f><nav><a>Home</a></nav><div>{text}</div></form>",
        f"<article class='legal news'>{text}</article><footer>f</footer>",
        f"<div class=share-price>{text}</div><nav>x</nav>",
        f"<a title=it's ok>x</a><article>{text}</article>",
        f"<div id=content>{text}</div><article class=card>Teaser</article><article>Another story</article>",
        f"<article>{text}</article><div class=comments>{text}{text}{text}</div><aside>{text}</aside>",
    ]
    got = main_texts(spark, [(i, f"http://n{i}.example/", c) for i, c in enumerate(cases)])
    assert got == dict.fromkeys(range(len(cases)), plain)
    assert set(main_texts(spark, [(i, "", c) for i, c in enumerate([f"<article></article><div class=ad>{text}</div>", "<div class=ad>Buy this</div>", f"<nav>{text}</nav>", f"<div hidden>{text}</div>"])]).values()) == {""}


def test_markup_as_browsers_read_it():
    x = html_extract.extract
    assert x("a<script>b</script>c<style>d</style><!-- e -->f", {}) == "a c f"
    assert x("<p>1 < 2 &amp; <b title='>'>b</b><math>x+1</math><object>seen</object><svg><text>no</text></svg><p>n<button>no</button><select><option>no</select>", {}) == "1 < 2 & bx+1seen\n\nn"
    assert x("<p>kept<button>never closed", {}) == "keptnever closed" and x("<p>a<script>never closed", {}) == "a"
    assert x("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", {}) == "a\n\nb\n\nc\n\nd"


@pytest.mark.parametrize("part", ["<p a='", "<p a='>'", '<a b="', "<!", "</", "<", "<div>", "<ul><li>", "<button>", "<script>", "&amp;", "<p>x"])
def test_large_odd_pages_take_linear_time(part):
    import time

    began = time.process_time()
    html_extract.features(part * (2_000_000 // len(part)))
    html_extract.extract(part * (2_000_000 // len(part)), {})
    assert time.process_time() - began < 20


def test_odd_pages(spark):
    rows = [(1, None, None, "k", 1), (1, None, None, "k", 1), (None, "http://a/", "<p>x" * 3, "k", 2), (2, "http://a/", "<p>" + "word " * 300_000, "k", 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, host int")
    got = sorted(((x["page_id"] or 0, x["text"][:9], x["n_chars"]) for x in html_extract.main_text(spark, df).collect()))
    assert got == [(0, "x\n\nx\n\nx", 7), (1, "", 0), (1, "", 0), (2, "word word", 1_499_999)]
    assert html_extract.main_text(spark, df.limit(0)).count() == 0


def test_style_tree_finds_what_comes_back(spark):
    page = "<body><div class=q>Subscribe now</div><div class=main{n}><p>Text {n} of its own</p><p>More {n} here</p></div></body>"
    rows = [(n, "http://c.example/", page.format(n=n)) for n in range(40)]
    got = html_extract.main_text(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {x["page_id"]: x["text"] for x in got} == {n: f"Text {n} of its own\n\nMore {n} here" for n in range(40)}


def test_values_of_odd_rows(spark, odd):
    """What the docstrings say of nulls, blanks, repeated rows, and columns named like those that are made."""
    clash = odd.withColumns({c: F.lit("mine") for c in ("__toxic_score", "__toxic", "__n_lines", "__n_dropped", "__ld_id", "__ld_text", "__ld_digest", "__ld_words", "__ld_bits", "carried", "s", "label", "features")})
    key = lambda x: (x["doc_id"] is None, x["doc_id"] or 0)
    lang = sorted(language_id.language_id(spark, clash).collect(), key=key)
    assert [x["lang_pred"] == "und" for x in lang] == [True, True, True, False, False, False, False, True, False, False]
    assert [x["score"] == 0 for x in lang] == [x["lang_pred"] == "und" for x in lang] and all(0 <= x["score"] <= 1 for x in lang)
    mix = sorted(mixing.mix(spark, clash).collect(), key=key)
    assert [x["size"] for x in mix] == [0, 0, 0, 3, 3, 60_000, 60_000, 2, 3, 8] and all(0 <= x["taken"] <= 3 * x["size"] and x["taken"] == x["copies"] * x["size"] for x in mix)
    assert {x["source"]: x["source_size"] for x in mix} == {None: 0, "a": 9, "b": 120_008, "c": 2}
    labels = spark.createDataFrame([(4, 0), (4, 1), (7, None), (None, 1)], "doc_id long, toxic int")
    tox = sorted(toxicity.toxicity(spark, clash, labels).collect(), key=key)
    assert all(0 <= x["__toxic_score"] <= 1 and x["__toxic"] == int(x["__toxic_score"] >= 0.5) and x["key"] == "k" for x in tox)
    assert tox[0]["__toxic_score"] == tox[1]["__toxic_score"] == tox[2]["__toxic_score"]
    lines = sorted(line_dedup.drop_repeated_lines(spark, clash, min_chars=5, min_docs=2).collect(), key=key)
    assert [x["__n_lines"] for x in lines] == [1, 1, 2, 1, 1, 1, 1, 1, 1, 2] and [x["__n_dropped"] for x in lines] == [0, 0, 0, 0, 0, 1, 0, 0, 0, 0]
    assert [x["text"] for x in lines[:2]] == ["", ""] and lines[5]["text"] == "" and len(lines[6]["text"]) > 200_000 and lines[9]["text"].startswith("a line") and all(x["key"] == "k" for x in lines)


def test_odd_rows_and_empty_tables(spark, odd):
    labels = spark.createDataFrame([(4, 1, 0), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    runs = {
        "language": lambda d: language_id.language_id(spark, d),
        "mixing": lambda d: mixing.mix(spark, d),
        "toxicity": lambda d: toxicity.toxicity(spark, d, labels),
        "near": lambda d: near_dedup.near_duplicates(spark, d),
        "lines": lambda d: line_dedup.drop_repeated_lines(spark, d),
        "counts": lambda d: token_counts.token_counts(spark, d, PATH),
        "codec": lambda d: bpe_codec.round_trip(spark, d, PATH),
    }
    n = odd.count()
    for name, run in runs.items():
        assert run(odd).count() == n, name
        assert run(odd.limit(0)).count() == 0, name
    near = {(x["doc_id"], x["n_shingles"]): x["component_id"] for x in runs["near"](odd).collect()}
    assert near[(5, 977)] == near[(6, 977)] == 5 and near[(8, 1)] == 4 and near[(1, 0)] == 1
