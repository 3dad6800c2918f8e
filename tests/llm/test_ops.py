"""Each operator against brute force on the awkward corpus, and on an empty one."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tracewell.llm import components, langid, lattice, media, mixing, pii, quality, simhash, substrings, token_ids, warc
from tracewell.llm.common import scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def words(t):
    return WORD.findall(t or "")


def test_langid(spark, docs, rows, none):
    keep = [F.col("doc_id")]
    got = langid.identify(docs.select("doc_id", "text", "lang"), keep).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
        assert r["lang_pred"] in {"en", "fr", "de", "und"}
    assert langid.identify(none.select("doc_id", "text", "lang"), keep).count() == 0


def test_langid_held_out_accuracy(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify(d, [F.col("doc_id"), F.col("lang"), langid.held_out(F.col("doc_id")).alias("out")]).where("out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.95
    assert {r["doc_id"] for r in got} == {i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2}


def test_ftrl_is_sparse_and_calibration_helps():
    rng = np.random.default_rng(1)
    data = [(np.array([y * 10 + int(rng.integers(10)), 100 + int(rng.integers(50))]), np.array([1, 1]), y) for y in rng.integers(0, 2, 300)]
    w = langid.train_ftrl(data, 2, np.ones(langid.SIZE))
    assert (w[:20] != 0).any() and (w[1000:-1] == 0).all()
    z, y = np.array([[4.0, 0.0]] * 10), np.array([0] * 6 + [1] * 4)
    assert langid.calibrate(z, y) > 2


def brute_quality(t):
    w, t = words(t), t or ""
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = collections.Counter(grams)
    covered = {k for i, g in enumerate(grams) if n[g] > 1 for k in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, docs, rows, none):
    got = quality.statistics(docs).select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    want = collections.Counter((r[0], *brute_quality(r[1])) for r in rows)
    assert collections.Counter(tuple(r) for r in got) == want
    labels = spark.createDataFrame([(0, 1), (3, 0), (3, 1), (None, 0), (5, None)], "doc_id long, quality int")
    assert quality.judge(docs, labels).count() == len(rows)
    assert quality.judge(none, labels.where("false")).count() == 0


def test_rules_find_a_planted_conjunction(spark):
    rng = random.Random(3)
    data = [(i, rng.randint(50, 500), rng.randint(0, 100)) for i in range(3000)]
    stats = spark.createDataFrame([(i, n, 5 * n, n * s // 100, 10, 0, 0, n // 2, 0, int(s > 60 and n < 250)) for i, n, s in data], "id long, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, n_distinct_words long, n_digits long, bad int")
    rules = quality.learn_rules(stats)
    got = stats.withColumn("rule", quality.rule_column(rules)).agg(F.avg((F.col("bad") == (F.col("rule") > 0).cast("int")).cast("int")).alias("a")).first()["a"]
    assert rules and got > 0.95
    assert quality.learn_rules(stats.withColumn("bad", F.lit(0))) == []


PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= digits(s) <= 19 and luhn(s)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= digits(s) <= 15),
]


def digits(s):
    return sum(c.isdigit() for c in s)


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(c if i % 2 == 0 else 2 * c - 9 * (c > 4) for i, c in enumerate(d)) % 10 == 0


def brute_pii(t):
    return sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(PII) for m in re.finditer(p, t or "") if ok(m[0]))


def test_pii(spark, docs, rows, none):
    got = pii.detect(docs, keep=["text"]).collect()
    assert collections.Counter((r[0], tuple(tuple(s) for s in r["base"])) for r in got) == collections.Counter((r[0], tuple(brute_pii(r[1]))) for r in rows)
    for r in got:
        assert set(map(tuple, r["base"])) <= set(map(tuple, r["spans"]))
    assert pii.detect(none).count() == 0


def test_pii_random_texts(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["@", ".", "a", "b_", "1", "23", "-", " ", "+", "(", ")", "4", "\n", "é", "9.9"]) for _ in range(rng.randint(0, 90))) for _ in range(1500)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [tuple(s) for s in r["base"]] for r in pii.detect(d).collect()}
    assert got == {i: brute_pii(t) for i, t in enumerate(texts)}


def test_redaction(spark, docs, rows):
    got = pii.redact(docs)
    assert got.columns == docs.columns and got.count() == len(rows)
    text = got.where("doc_id = 0").first()["text"]
    assert "jane.doe" not in text and "<EMAIL>" in text and "<PHONE>" in text
    assert got.where("text IS NULL").count() == docs.where("text IS NULL").count()


def test_redaction_of_long_secrets(spark):
    rng = random.Random(9)
    secrets = ["".join(rng.choice("0123456789abcdef") for _ in range(n)) for n in (28, 256, 257, 1000, 20000)]
    d = spark.createDataFrame([(i, f"the token={s} is here") for i, s in enumerate(secrets)], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in pii.redact(d).collect()} == {i: "the <SECRET> is here" for i in range(len(secrets))}


def test_em_trusts_agreeing_labelers():
    post = pii.estimate([(2 + 2 * 3 + 2 * 9 + 2 * 27, 50), (1 + 1 * 3 + 1 * 9 + 1 * 27, 50), (2 + 1 * 3, 5)])
    assert post[80] > 0.9 and post[40] < 0.1


def test_token_files(spark, docs, rows, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    folder = scratch(spark, "test-ids")
    token_ids.write_token_files(docs, folder, path)
    tie = {r["text"]: r["h"] for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    want, at = [], 0
    for key, t in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, tie[r[1]])):
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((key, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert collections.Counter(tuple(r) for r in token_ids.token_digests(spark, folder).collect()) == collections.Counter(want)
    ids = {r["doc_id"]: r["ids"] for r in token_ids.read_token_ids(spark, folder).where("doc_id = 12").collect()}
    assert model.decode(ids[12][:-1]) == rows[12][1]
    empty = scratch(spark, "test-ids")
    token_ids.write_token_files(none, empty, path)
    assert token_ids.token_digests(spark, empty).count() == 0


def test_coding_round_trip():
    rng = np.random.default_rng(2)
    for n in (0, 1, 3, 4, 5, 1000):
        x = (2 ** (rng.random(n) * 32)).astype(np.uint32)
        assert (token_ids.unpack(*token_ids.pack(x), n) == x).all()
    with pytest.raises(ValueError):
        token_ids.unpack(b"\x00", b"ab", 1)


def test_added_tokens_are_the_library_s(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    token_ids.write_token_files(spark.createDataFrame([(1, "a <|endoftext|> b"), (2, "<|endoftext|>"), (3, "a <|endoftext b")], "doc_id long, text string"), f"file://{tmp_path}/t", path)
    got = {r["doc_id"]: r["ids"] for r in token_ids.read_token_ids(spark, f"file://{tmp_path}/t").collect()}
    assert got[1] == [64, 220, 50256, 275, 2] and got[2] == [50256, 2] and 50256 not in got[3]


def test_pieces_equal_the_library():
    t = token_ids.PieceTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(4)
    bits = ["the", " ", "  ", "\n", ".", ",", "don't", "é", "日", "1", "_", "'s", "\t", "!", " x", "\x01", "\x02", " ", "ing.", "A,\nB"]
    texts = [None, "", *("".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(800))]
    for text, got in zip(texts, t.encode(pa.array(texts)), strict=True):
        assert np.frombuffer(got, t.dtype).tolist() == t.model.encode(text or "", add_special_tokens=False).ids, text


def test_simhash(spark, docs, rows, none):
    def fp(t):
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        g = [" ".join(w)] if 0 < len(w) < 3 else [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in g]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0

    prints = [(r[0], fp(r[1])) for r in rows]
    part = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if (prints[i][1] ^ prints[j][1]).bit_count() <= 3:
            a, b = part[i], part[j]
            part = [a if x == b else x for x in part]
    want = collections.Counter((k, f, min((prints[j][0] for j in range(len(rows)) if part[j] == part[i] and prints[j][0] is not None), default=None)) for i, (k, f) in enumerate(prints))
    got = simhash.near_duplicates(docs).collect()
    assert collections.Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got) == want
    assert simhash.near_duplicates(none).count() == 0


def test_links_of_crowded_buckets(spark):
    """A hot group: hundreds of fingerprints that differ in few bits, so that level two does the work."""
    rng = random.Random(6)
    base = rng.getrandbits(64)
    fps = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(700)} | {rng.getrandbits(64) for _ in range(300)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), max_bucket=16)
    got = {r["node"]: r["component"] for r in components.connected_components(links).collect()}
    arr, label = np.array(signed, dtype=np.int64), {x: x for x in signed}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, x in enumerate(signed):
        for y in arr[i + 1 :][np.bitwise_count((arr[i + 1 :] ^ arr[i]).view(np.uint64)) <= 3].tolist():
            a, b = root(x), root(y)
            label[max(a, b)] = min(a, b)
    assert {x: got.get(x, x) for x in signed} == {x: root(x) for x in signed}


def test_masks_cover():
    for step, offset in ((1, 0), (37, 11)):
        masks = simhash.covering_masks(3, step=step, offset=offset)
        rng = random.Random(1)
        for _ in range(3000):
            d = sum(1 << b for b in rng.sample(range(64), 3))
            assert any(not m & d for m in masks)


def test_components(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 502), (7, 7)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500, 502: 500}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each(spark, docs, rows):
    left = simhash.one_of_each(docs)
    assert left.columns == docs.columns
    ids = [r["doc_id"] for r in left.collect()]
    assert ids.count(0) == 1 and 1 not in ids and ids.count(3) == 1 and 4 not in ids


def test_media(spark, docs, rows, none):
    got = media.media_features(media.to_media(docs)).collect()
    want = []
    for r in rows:
        b = (r[1] or "").encode()
        n = len(b)
        b += b" " * (-n % 192 or (0 if n else 192))
        want.append((r[0], n, len(b), hashlib.sha256(b).hexdigest(), zlib.crc32(b[-16:])))
    assert collections.Counter((r["id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == collections.Counter(want)
    same = {}
    for r in got:
        assert same.setdefault(r["payload_sha256"], (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])
    assert media.media_features(media.to_media(none)).count() == 0


def test_png_filters_and_checksums():
    rng = np.random.default_rng(3)
    image = rng.integers(0, 256, (12, 192), dtype=np.uint8)
    lines = np.zeros((12, 193), dtype=np.uint8)
    for y in range(12):
        kind = y % 5
        up = image[y - 1].astype(int) if y else np.zeros(192, int)
        left, corner = np.concatenate([np.zeros(3, int), image[y, :-3].astype(int)]), np.concatenate([np.zeros(3, int), up[:-3]])
        guess = [np.zeros(192, int), left, up, (left + up) // 2, media._paeth(left, up, corner)][kind]
        lines[y, 0], lines[y, 1:] = kind, (image[y] - guess) % 256
    assert (media.unfilter(lines, 3) == image).all()
    png = media.encode_png(image.tobytes())
    assert (media.decode_png(png) == image).all()
    for k in (0, 20, 45, len(png) - 6):
        with pytest.raises((ValueError, zlib.error)):
            media.decode_png(png[:k] + bytes([png[k] ^ 1]) + png[k + 1 :])


def test_mixing(spark, docs, rows, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["copies"] <= 3
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.mix(none).count() == 0 and mixing.mixed(docs).columns == docs.columns


def test_mix_comes_near_its_targets(spark):
    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") * 37 % 50 + 1).cast("int")).alias("text"), F.concat(F.lit("s"), (F.col("id") * F.col("id") % 7).cast("string")).alias("source"))
    t = mixing.mix(d).groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("size") * F.col("copies")).alias("got")).collect()
    assert all(abs(r["got"] - r["t"]) <= 26 for r in t)


def test_longer_documents_are_likelier(spark):
    """Sampled shares of each size class are near the probabilities that a plain water filling gives."""
    sizes = [2, 5, 20, 70, 300]
    n, of = 6000, lambda i: sizes[i % 5]
    d = spark.range(n).select(F.col("id").alias("doc_id"), F.element_at(F.array(*[F.lit(x) for x in sizes]), (F.col("id") % 5 + 1).cast("int")).alias("n"))
    d = d.select("doc_id", F.repeat(F.lit("w "), F.col("n")).alias("text"), F.when(F.col("doc_id") % 3 == 0, "a").otherwise("b").alias("source"))
    got = mixing.mix(d).collect()
    for source in ("a", "b"):
        mine = [r for r in got if r["source"] == source]
        total, target = mine[0]["source_size"], mine[0]["target"]
        whole = int(target // total)
        words_of = collections.Counter()
        for r in mine:
            words_of[r["size"]] += r["size"]
        odds = {x: 2.0 ** ((x.bit_length() - 1) // 2) for x in sizes}
        left, free, part = target - whole * total, set(sizes), {}
        while free:
            level = left / sum(odds[x] * words_of[x] for x in free)
            full = {x for x in free if odds[x] * level >= 1}
            if not full:
                part |= {x: odds[x] * level for x in free}
                break
            part |= dict.fromkeys(full, 1.0)
            left -= sum(words_of[x] for x in full)
            free -= full
        share = {x: sum(r["copies"] - whole for r in mine if r["size"] == x) / sum(r["size"] == x for r in mine) for x in sizes}
        assert all(abs(share[x] - part[x]) < 0.07 for x in sizes), (source, share, part)
        assert share[2] < share[20] < share[300] or share[300] == 1


def test_substrings(spark, docs, rows, none):
    got = substrings.deduplicated(docs).collect()
    first, want = {}, []
    for key, t in sorted(((r[0], r[1]) for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = words(t)
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), key)
    for r in rows:
        w = words(r[1])
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if r[0] is not None and first[tuple(w[i : i + 13])] < r[0]:
                gone[i : i + 13] = [True] * 13
        want.append((r[0], len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    assert collections.Counter(tuple(r) for r in got) == collections.Counter(want)
    assert substrings.deduplicated(none).count() == 0


def test_what_is_sent_does_not_grow_with_the_parts():
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 400)) for _ in range(600)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(600), pa.int64()), pa.array([0] * 600, pa.int64()), pa.array(texts)], names=["id", "tag", "text"])
    none = [np.zeros(0, dtype=np.uint64)] * 4

    def sent(parts):
        rows = [r for b in substrings._ship(none, parts)(iter([batch])) for r in b.to_pylist()]
        assert sum(r["kind"] == 1 for r in rows) == 1
        return sum(len(r["blob"]) + len(r["docs"]) for r in rows)

    few = sent(16)
    assert sent(256) < 1.4 * few and sent(2048) < 2 * few


def test_frequent_prefixes_split_further(spark, monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(["the", "same"] + [rng.choice("ab") for _ in range(40)]) for _ in range(60)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: r["n_removed"] for r in substrings.deduplicated(d).collect()}
    seen, want = {}, {}
    for i, t in enumerate(texts):
        w = t.split()
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if seen.setdefault(tuple(w[k : k + 13]), i) < i:
                gone[k : k + 13] = [True] * 13
        want[i] = sum(gone)
    assert got == want


def test_warc(spark):
    big = "x" * 150
    pages = [(3, "http://a/", big), (1, "http://b/", big), (2, None, big), (4, "u\r\nv", "small"), (5, "http://c/", "small"), (6, "http://d/", None), (7, "http://e/", ""), (None, "http://f/", big), (8, "http://g/", "é" * 60), (9, "http://g/", "é" * 60), (1, "http://b2/", big)]
    d = spark.createDataFrame([(*p, "z", 1) for p in pages], "page_id long, url string, html string, digest string, first long")
    folder = scratch(spark, "test-warc")
    index = warc.write_archives(d, folder)
    got = collections.Counter(tuple(r) for r in warc.read_records(index, folder).collect())
    want = collections.Counter()
    for k, _, h in pages:
        b = (h or "").encode()
        of = [p[0] for p in pages if (p[2] or "") == (h or "") and p[0] is not None]
        to = min(of) if len(b) >= 100 and of and k != min(of) else None
        want[(k, len(b), hashlib.sha256(b).hexdigest(), "response" if to is None else "revisit", to)] += 1
    assert got == want
    some = warc.read_records(index.where("page_id IN (2, 4)"), folder)
    assert sorted(r["page_id"] for r in some.collect()) == [2, 4]
    assert warc.read_records(warc.write_archives(d.where("false"), scratch(spark, "test-warc")), folder).count() == 0


def test_warc_records():
    data = warc.record(1, "http://x/", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    assert warc.parse(data)[1] == b"payload"
    with pytest.raises(Exception):  # noqa: B017
        warc.parse(data[:-4])
    assert warc.coalesced([(0, 10), (10, 5), (20, 5), (10**6, 3)]) == [(0, 25, 3), (10**6, 10**6 + 3, 1)]


def best(pieces, table, w):
    at = [(0.0, 0, [])]
    for e in range(1, len(w) + 1):
        ways = []
        for n in range(1, min(e, pieces.longest) + 1):
            p = w[e - n : e]
            if p in table:
                ways.append((at[e - n][0] + table[p][1], n, [table[p][0]]))
            elif n == 1:
                ways.append((at[e - n][0] + pieces.unknown, n, [b + pieces.byte_base for b in p.encode()]))
        at.append(max(ways, key=lambda z: (z[0], z[1])))
    out, k = [], len(w)
    while k:
        out.append(at[k][2])
        k -= at[k][1]
    return [i for x in out[::-1] for i in x]


def test_lattice(spark, docs, rows, none):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces, sp = lattice.Pieces.load(path), sentencepiece.SentencePieceProcessor(model_file=path)
    table = {p: (i, s) for p, i, s in pieces.rows}
    coded = lattice.encode(docs, path)
    assert coded.columns == [*[c for c in docs.columns if c != "token_ids"], "token_ids"]
    got = [(r["doc_id"], r["text"], np.frombuffer(r["token_ids"], "<u4").tolist()) for r in coded.collect()]
    assert collections.Counter((k, t) for k, t, _ in got) == collections.Counter((r[0], r[1]) for r in rows)
    for _, t, ids in got:
        if not t:
            assert ids == []
            continue
        want = [i for w in re.split("(?<!▁)(?=▁)", "▁" + t.replace(" ", "▁")) for i in best(pieces, table, w)]
        assert ids == want
        assert sp.decode(ids) == t and lattice.decode_ids(np.array(ids, "<u4").tobytes(), pieces) == t
    assert lattice.encode(none, path).count() == 0


def test_long_units(spark):
    pieces = lattice.Pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    table = {p: (i, s) for p, i, s in pieces.rows}
    rng = random.Random(2)
    units = {"".join(rng.choice("etaoinshrdlu") for _ in range(n)) for n in (1, 5, 63, 64, 65, 300, 1000)} | {"▁hello", "日本語テキスト", "ab😀cd\nq", "a" * 700}
    got = {r["unit"]: r["ids"] for r in lattice.best_paths(spark.createDataFrame([(u,) for u in units], "unit string"), pieces).collect()}
    assert got == {u: best(pieces, table, u) for u in units}


def test_units_longer_than_stretches(spark, monkeypatch):
    """Long units, cut into stretches and segments, give what brute force gives; also where stretches are tiny."""
    pieces = lattice.Pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    table = {p: (i, s) for p, i, s in pieces.rows}
    rng = random.Random(4)
    units = {"".join(rng.choice(letters) for _ in range(n)) for n in (257, 600, 1300, 3000) for letters in ("etaoinshrdlu", "0123456789abcdef", "ab=日é")} | {"=" * 900, "abc" * 400}
    for outer, inner in ((1 << 16, 256), (100, 30)):
        monkeypatch.setattr(lattice, "_OUTER", outer)
        monkeypatch.setattr(lattice, "_INNER", inner)
        got = {r["unit"]: r["ids"] for r in lattice.best_paths(spark.createDataFrame([(u,) for u in units], "unit string"), pieces).collect()}
        assert got == {u: best(pieces, table, u) for u in units}


def test_a_unit_of_a_megabyte(spark):
    pieces = lattice.Pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(6)
    unit = "".join(rng.choices("0123456789abcdefghijklmnopqrstuvwxyz", k=1 << 20))
    ids = lattice.best_paths(spark.createDataFrame([(unit,)], "unit string"), pieces).first()["ids"]
    assert b"".join(pieces.text_of[i] for i in ids).decode() == unit


def test_cuts_do_not_depend_on_windows(monkeypatch):
    cut = lattice.Cutter(lattice.Pieces.load(public_tokenizers.path("piece_bpe_32k.model")).pairs)
    texts = ["The end. Is it, really?\nYes \x01 x", None, "", "日本 ab", "😀😀 é", " "]
    units, first = cut.units(texts)
    for window in (1, 2, 3, 7):
        monkeypatch.setattr(lattice, "_WINDOW", window)
        got, at = cut.units(texts)
        assert got.to_pylist() == units.to_pylist() and at.tolist() == first.tolist()


def test_cuts_cross_no_piece():
    pieces = lattice.Pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    cut = lattice.Cutter(pieces.pairs)
    texts = ["The end. Is it, really?\nYes \x01 x", None, "", "日本 ab"]
    units, first = cut.units(texts)
    for k, t in enumerate(texts):
        own = units.slice(first[k], first[k + 1] - first[k]).to_pylist()
        assert "".join(own) == ("▁" + t.replace(" ", "▁") if t else "")
        for a, b in itertools.pairwise(own):
            assert a[-1] + b[0] not in pieces.pairs


def test_encoding_survives_other_file_splits(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    key, usual = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    read = lambda: spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = {r["doc_id"]: r["token_ids"] for r in lattice.encode(read(), path).collect()}
    try:
        spark.conf.set(key, 30_000)
        coded = lattice.encode(read(), path)
        spark.conf.set(key, usual)
        got = {r["doc_id"]: r["token_ids"] for r in coded.collect()}
    finally:
        spark.conf.set(key, usual)
    assert got == want


def test_one_path_equals_the_relational_one(spark):
    pieces = lattice.Pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    known = {p: (i, x) for p, i, x in pieces.rows}
    rng = random.Random(12)
    units = sorted({"".join(rng.choice("▁abehtn=.é日😀") for _ in range(rng.randint(1, 90))) for _ in range(150)} | {"=" * 70, "▁" * 40})
    got = {r["unit"]: r["ids"] for r in lattice.best_paths(spark.createDataFrame([(u,) for u in units], "unit string"), pieces).collect()}
    assert got == {u: lattice.one_path(u, known, pieces.longest, pieces.unknown, pieces.byte_base) for u in units}
