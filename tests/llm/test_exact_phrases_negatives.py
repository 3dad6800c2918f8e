"""Exact dedup, collocations and hard negatives against brute force."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import collocations, exact, negatives


def brute_exact(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[hashlib.sha256((r[1] or "").encode()).hexdigest()].append(r[0])
    out = collections.Counter()
    for sha, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        left = 1
        for i in ids:
            out[i, keep, len(ids), i == keep and left == 1, sha] += 1
            left -= i == keep
    return out


def test_exact(spark, docs, rows, none):
    assert collections.Counter(tuple(r) for r in exact.deduplicate(docs).collect()) == brute_exact(rows)
    assert exact.deduplicate(none).collect() == []


def test_exact_hot_group_and_long_text(spark):
    rows = [(i, "same" if i % 3 else f"own {i}") for i in range(4000)] + [(7000 + i, "x" * 3_000_000 + str(i % 2)) for i in range(3)]
    got = exact.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert collections.Counter(tuple(r) for r in got) == brute_exact(rows)


def test_index_takes_batches_in_turn(spark):
    rng = random.Random(5)
    rows = [(i, f"t{rng.randint(0, 300)}") for i in range(1500)]
    marked = exact.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
    index = None
    for k in range(11):
        index = exact.absorb(index, marked.where(F.col("doc_id") % 11 == k))
    assert index.rows.groupBy("bucket").count().agg(F.max("count")).first()[0] <= exact.MAX_SEGMENTS + 1
    assert index.rows.agg(F.sum("n_rows")).first()[0] == len(rows)
    got = exact.resolve(index, marked).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")))
    assert collections.Counter(tuple(r) for r in got.collect()) == brute_exact(rows)


def test_perfect_hash_is_minimal_and_lookups_compare_bytes():
    words = lambda a, b: np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(a, b)), "<u8").reshape(-1, 4)
    keys = words(0, 5000)
    mph = exact.PerfectHash.of(keys)
    assert sorted(mph.find(keys)) == list(range(5000))
    segment = exact.Segment.from_bytes(exact.Segment.of(keys, np.arange(20000).reshape(-1, 4)).to_bytes())
    assert (segment.keys[segment.find(keys)] == keys).all()
    assert (exact.PerfectHash.of(keys).find(words(5000, 9000)) >= 0).any()  # some strangers get a slot, but
    assert (segment.find(words(5000, 9000)) == -1).all()
    with pytest.raises(ValueError):
        exact.PerfectHash.of(np.concatenate([keys[:3], keys[:3]]))
    assert exact.PerfectHash.of(keys[:0]).find(keys[:2]).tolist() == [-1, -1]


def brute_phrases(rows, least, top):
    f, out = collections.Counter(), []
    for text, lang in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            w = re.findall("[^ \t]+", piece)
            f.update((lang or "und", *w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    n = collections.Counter()
    for p, c in f.items():
        n[p[0]] += c * (len(p) == 2)
    found = {p: c for p, c in f.items() if len(p) > 2 and c >= least}
    for p, a in found.items():
        if len(p) == 3 and any(2 * found.get(q, 0) >= a for q in found if len(q) == 4 and q[0] == p[0] and (q[1:3] == p[1:] or q[2:] == p[1:])):
            continue
        cuts = []
        for k in range(1, len(p) - 1):
            left, right = f[p[: k + 1]], f[(p[0], *p[k + 1 :])]
            cuts.append((10**6 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.append((p[0], " ".join(p[1:]), a, left, right, n[p[0]], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    return [(r[0], i + 1, *r[1:]) for _, g in itertools.groupby(out, key=lambda r: r[0]) for i, r in enumerate(g) if i < top]


@pytest.mark.parametrize(("least", "top"), [(2, 2000), (1, 40)])
def test_collocations(spark, docs, rows, none, least, top):
    got = collocations.collocations(docs, least, top).orderBy("lang", "rank").collect()
    assert [tuple(r) for r in got] == brute_phrases([(r[1], r[2]) for r in rows], least, top)
    assert collocations.collocations(none).collect() == []


def test_collocations_of_a_long_text_and_rare_language(spark):
    rng = random.Random(2)
    rows = [(" ".join(rng.choice("ab cd ef. gh, Ij\tk\x01 é".split(" ")) for _ in range(60_000)), "en"), ("ab cd " * 30, None), ("\x0b\x0c\r", "zz"), (None, None)]
    got = collocations.collocations(spark.createDataFrame(rows, "text string, lang string")).orderBy("lang", "rank").collect()
    assert [tuple(r) for r in got] == brute_phrases(rows, 10, 2000)


def test_tries_survive_splitting_and_merging():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 2) for _ in range(400)) + "." for _ in range(5)]
    shards = []
    for t in texts:
        c = collocations.Counter()
        c.add(t)
        shards.append(c.paths())
    words, paths = collocations.merge(shards)
    named = lambda w, p: collections.Counter({tuple(w[i] for i in x): int(n) for *x, n in zip(*p, strict=True)})
    want = collections.Counter()
    for t in texts:
        w = [*t.rstrip(".").encode().split(), b"", b""]
        want.update(zip(w, w[1:], w[2:], strict=False) if w[-3:] else [])
    want = collections.Counter({(a, b, c if b else b""): n for (a, b, c), n in want.items() if a})
    assert named(words, paths) == want and len(paths[0]) == len(want)
    bounds = sorted(rng.sample(sorted(want), 7) + [(b"zz", b"", b""), (b"c", b"dd", b"zz"), (b"", b"", b"")])
    at = [0, *collocations.cuts(words, paths, bounds), len(paths[0])]
    order = sorted(want)
    assert at[1:-1] == [sum(p < b for p in order) for b in bounds]
    back = collections.Counter()
    for a, b in itertools.pairwise(at):
        if b > a:
            back += named(*collocations.from_bytes(collocations.to_bytes(words, tuple(x[a:b] for x in paths))))
    assert back == want
    # Counts beyond what packs into one number of 63 bits.
    big = np.array([3, 1, 3]) << 28
    a, b, c, n = collocations.tally(big, big, big, np.array([1, 2, 4]))
    assert (a >> 28).tolist() == [1, 3] and n.tolist() == [2, 5]


def brute_negatives(rows):
    kept = {}
    for i, v, y in rows:
        if i is None or y is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * float(np.float32(x))) for x in v]
        if sum(x * x for x in q) >= 2**62:
            continue
        y = int(math.fmod(y + 1, 10)) if i % 7 == 0 else y
        kept[i] = min(kept.get(i, (y, q)), (y, q))
    out = set()
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for i in kept:
        if i % 50:
            continue
        s = sorted((-dot(kept[i][1], v), j, y) for j, (y, v) in kept.items() if j != i)
        for p, j, _ in [x for x in s if x[2] == kept[i][0]][:5]:
            fit = [(n, k) for n, k, y in s if y != kept[i][0] and 50 * -p <= 100 * -n <= 95 * -p][:3]
            out |= {(i, j, r + 1, k, -p, -n) for r, (n, k) in enumerate(fit)}
    return out


def mined(spark, rows):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit("clash") for c in ("norm2", "place", "rank", "score", "id", "stripe", "kind", "part")})
    return negatives.hard_negatives(d, F.col("vec_id") % 50 == 0, label).collect()


def test_negatives(spark):
    rng = random.Random(8)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.25, 0.5, 1.0]) * rng.choice([0.1, 1, 3]) for _ in range(6)], rng.randint(0, 9)) for i in range(900)]
    rows += [(900 + i, [1.0, 0.5, 0.25, 0.25, 0.1, 0.3], i % 4) for i in range(500)]  # one vector many times: ties
    rows += [(2000, None, 1), (2050, [1.0, None, 2.0], 1), (2100, [float("nan")] * 6, 2), (2150, [float("inf")] * 6, 2), (None, [1.0] * 6, 3), (2200, [1.0] * 6, None)]
    rows += [(2250, [], 3), (2300, [1.0, 2.0], 3), (2350, [1e5] * 6, 3), (2351, [3e5] * 6, 4), (2352, [1e30] * 6, 4), (0, rows[0][1], rows[0][2]), (50, [9.0] * 6, 9), (-50, [0.0] * 6, 5)]
    got = mined(spark, rows)
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute_negatives(rows)
    assert mined(spark, []) == []


def test_search_keeps_ties_and_whole_windows():
    rng = np.random.default_rng(4)
    v = rng.integers(-3, 4, (700, 5))
    ids, labels = rng.permutation(700).astype(np.int64), rng.integers(0, 3, 700)
    order = np.argsort(-(v**2).sum(axis=1))
    packs = [negatives.Pack(float(np.sqrt((v[o] ** 2).sum(axis=1).max())), ids[o], labels[o], v[o]) for o in np.array_split(order, 9)]
    anchors = negatives.Pack(0.0, ids[:20], labels[:20], v[:20])
    owner = np.repeat(np.arange(20), 2)
    low, high = rng.integers(-20, 10, 40), rng.integers(5, 30, 40)
    w, found, score = negatives.search(packs, anchors, np.sqrt((v[:20] ** 2).sum(axis=1)), owner, low, high, 3, False)
    for i in range(40):
        s = v @ v[owner[i]]
        want = sorted((-int(x), int(k)) for x, k, y in zip(s, ids, labels, strict=True) if y != labels[owner[i]] and low[i] <= x <= high[i])[:3]
        assert [(-int(a), int(b)) for a, b in zip(score[w == i], found[w == i], strict=True)] == want


def test_limits_are_exact():
    for p in [*range(-45, 45), 2**62 - 1, 2**61 + 7]:
        low, high = (int(x[0]) for x in negatives.limits(np.array([p], np.int64)))
        assert 50 * p <= 100 * low < 50 * p + 100 and 100 * high <= 95 * p < 100 * high + 100
