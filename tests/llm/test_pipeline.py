"""The stages on the awkward corpus and on driver data."""

from __future__ import annotations

import collections
import random

import numpy as np
import public_tokenizers

import corpus_pipeline
from tracewell.llm import lattice, similar, simhash
from tracewell.llm.common import written


def test_stages_keep_columns_and_decide(spark, docs):
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, docs, ""), "test-stage")
        if name != "sentencepiece_ids":
            assert docs.columns == before.columns, name
    assert docs.count() > 0


def test_stages_on_nothing(spark, none):
    docs = none.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0, name


def components_by_brute_force(rows):
    """A number and the least id of each row's component: 5-word Jaccard >= 0.8 or no word at all, over all pairs that share a shingle."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset([b" ".join(w)] if 0 < len(w) <= 5 else [b" ".join(w[i : i + 5]) for i in range(len(w) - 4)]))
    label = {s: s for s in sets}

    def root(s):
        while label[s] is not s:
            s = label[s]
        return s

    label = {s: s for s in label}
    nodes, having = list(label), collections.defaultdict(list)
    for i, s in enumerate(nodes):
        common = collections.Counter(j for g in s for j in having[g])
        for j, n in common.items():
            if n / (len(s) + len(nodes[j]) - n) >= 0.8:
                label[root(s)] = root(nodes[j])
        for g in s:
            having[g].append(i)
    least = {}
    for (k, _), s in zip(rows, sets, strict=True):
        r = root(label[s])
        least[r] = min((x for x in (k, least.get(r)) if x is not None), default=None)
    number = {r: i for i, r in enumerate(least)}
    return [(number[root(label[s])], least[root(label[s])]) for s in sets]


def near_texts(n=140):
    """A base text, copies of it that are near one another, near the base only, or just below the limit, and other texts."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**6)}"
    base = [word() for _ in range(204)]
    rows = [(500, " ".join(base))]
    for i in range(n):
        w = list(base)
        for at in rng.sample(range(0, 204, 6), 1 + i % 6):
            w[at] = word()
        rows.append((1000 + i, " ".join(w)))
    rows += [(i, " ".join(word() for _ in range(40))) for i in range(20)]
    return rows + [(2000 + i, " ".join(base[: 100 + 4 * i])) for i in range(26)]


def test_near_dedup_by_brute_force(spark, docs, rows):
    awkward = [(r[0], r[1]) for r in rows]
    sample = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    for data in (awkward, sample, near_texts()):
        d = spark.createDataFrame(data, "doc_id long, text string")
        want = components_by_brute_force(data)
        for size in (similar.MAX_BUCKET, 3):
            got = collections.Counter((r["doc_id"], r["component_id"]) for r in similar.near_copies(d, max_bucket=size).collect())
            assert got == collections.Counter((k, c) for (k, _), (_, c) in zip(data, want, strict=True))
        # One row of each component, also where two components have the same id.
        kept = [r["doc_id"] for r in stage(spark, d, "").collect()]
        assert collections.Counter(kept) == collections.Counter(c for _, c in set(want))
    assert {2, 56} & set(r["doc_id"] for r in stage(spark, spark.createDataFrame(sample, "doc_id long, text string"), "").collect()) != {2, 56}


def test_near_dedup_groups_by_simhash(spark):
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(words), " ".join([*words[:-1], "other"]), " ".join(f"v{i}" for i in range(3000))]
    sets = [similar.shingles_of(t) for t in texts]
    nodes = [(similar.node_of(s), simhash.majority(s)) for s in sets]
    got = similar.simhash_pairs(spark.createDataFrame(nodes, "node long, fp long")).collect()
    assert [{r["a"], r["b"]} for r in got] == [{nodes[0][0], nodes[1][0]}]


def test_run(spark):
    pieces = lattice.Pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows
    for r in rows:
        assert lattice.decode_ids(r["token_ids"], pieces) == r["text"] and len(np.frombuffer(r["token_ids"], "<u4"))
        assert "@mail" not in r["text"] or "<EMAIL>" not in r["text"]
