"""Keyed hashes, spans, headers, merged stores and campaigns."""

from __future__ import annotations

import datetime
import hashlib
import hmac
import itertools
import random

from pyspark.sql import functions as F

from tracewell.functions import keyed
from tracewell.operators import headers, spans
from tracewell.streaming.campaigns import Campaigns
from tracewell.streaming.store import KeyedStore

T0 = datetime.datetime(2024, 1, 1)


def test_hmac_equals_published_vectors(spark):
    # RFC 4231, cases 1, 2, 3, 6 and 7.
    cases = [
        (b"\x0b" * 20, b"Hi There", "b0344c61d8db38535ca8afceaf0bf12b881dc200c9833da726e9376c2e32cff7"),
        (b"Jefe", b"what do ya want for nothing?", "5bdcc146bf60754e6a042426089575c75a003f089d2739839dec58b964ec3843"),
        (b"\xaa" * 20, b"\xdd" * 50, "773ea91e36800e46854db8ebd09181a72959098b3ef8c122d9635514ced565fe"),
        (b"\xaa" * 131, b"Test Using Larger Than Block-Size Key - Hash Key First", "60e431591ee0b67f0d8a26aacbf5b77f8e0bc6213728c5140546040f0ee37f54"),
        (b"\xaa" * 131, b"This is a test using a larger than block-size key and a larger than block-size data. The key needs to be hashed before being used by the HMAC algorithm.", "9b09ffa71b942fcb27635fbcd5b0e944bfdc63644f0713938a7f51535c3a35e2"),
    ]
    rng = random.Random(1)
    cases += [(k, m, hmac.new(k, m, hashlib.sha256).hexdigest()) for k, m in ((rng.randbytes(n), rng.randbytes(n * 3)) for n in (0, 1, 63, 64, 65, 200))]
    d = spark.createDataFrame([(bytearray(k), bytearray(m)) for k, m, _ in cases], "k binary, m binary")
    assert [r[0] for r in d.select(keyed.hmac_sha256(F.col("k"), F.col("m"))).collect()] == [x for *_, x in cases]
    d = spark.createDataFrame([("o", "A@b.c"), ("o", "a@B.C"), ("p", "a@b.c"), ("o", None), ("o", "")], "o string, v string")
    got = [r[0] for r in d.select(keyed.pseudonym(F.lit("s"), F.col("o"), F.col("v"))).collect()]
    assert got[0] == got[1] == hmac.new(b"s", b"o\0a@b.c", hashlib.sha256).hexdigest()[:32] and got[2] != got[0] and got[3:] == [None, None]


def test_spans_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [(i % 9, a, a + rng.randint(0, 9), rng.randint(0, 2), rng.choice("xy")) for i, a in enumerate(rng.randint(0, 60) for _ in range(400))]
    rows += rows[:20]
    want = set()
    for d in range(9):
        kept = []
        for r in sorted({r for r in rows if r[0] == d and r[2] > r[1]}, key=lambda r: (-r[3], r[1], r[1] - r[2], r[2], r[4])):
            if all(r[1] >= k[2] or k[1] >= r[2] for k in kept):
                kept.append(r)
        want |= set(kept)
    s = spans.resolved(spark.createDataFrame(rows, "id long, start int, end int, rank int, label string"), ["id"])
    assert {tuple(r) for r in s.collect()} == want
    texts = [(d, "".join(rng.choice("abc") for _ in range(75))) for d in range(9)] + [(20, ""), (21, None), (22, "plain")]
    parts = spans.segments(spark.createDataFrame(texts, "id long, text string"), s, "id").orderBy("id", "place").collect()
    for d, x in texts:
        mine = [r for r in parts if r["id"] == d]
        assert "".join(r["part"] for r in mine) == (x or "") and len(mine) >= 1
        assert {(r["start"], r["end"], r["label"]) for r in mine if r["label"]} == {(r[1], r[2], r[4]) for r in want if r[0] == d}


def test_policies_and_cookies(spark):
    d = spark.createDataFrame([("Default-Src 'self'  https: ; default-src *;; img-src, frame-ancestors 'none'",), ("",), (None,)], "v string")
    assert [dict(r[0]) for r in d.select(headers.policy(F.col("v"))).collect()] == [{"default-src": ["'self'", "https:"], "img-src": [], "frame-ancestors": ["'none'"]}, {}, {}]
    d = spark.createDataFrame([("a=b; Secure; HTTPONLY; SameSite = x",), ("sid=1; samesite=Lax",), ("=v",), ("",)], "v string")
    assert [tuple(r[0]) for r in d.select(headers.cookie(F.col("v"))).collect()] == [("a", True, True, None), ("sid", False, False, "Lax"), ("", False, False, None), ("", False, False, None)]


def test_header_findings(spark):
    good = {"content-security-policy": "default-src 'self'; base-uri 'self'; frame-ancestors 'none'", "strict-transport-security": "max-age=31536000; includeSubDomains", "x-content-type-options": "nosniff", "referrer-policy": "origin", "permissions-policy": "camera=()", "cross-origin-opener-policy": "same-origin", "server": "nginx"}
    d = spark.createDataFrame([(1, "https:", good, ["s=1; Secure; HttpOnly; SameSite=Lax"]), (2, "http:", None, None)], "id long, protocol string, headers map<string,string>, cookies array<string>")
    got = {(r["id"], r["kind"]) for r in headers.findings(d).collect()}
    assert {k for i, k in got if i == 1} == set()
    assert {k for i, k in got if i == 2} == {"missing policy", "missing x-content-type-options", "missing referrer-policy", "missing permissions-policy", "missing cross-origin-opener-policy", "any site may frame"}
    p = spark.createDataFrame([(1, ".git/HEAD", 200, "ref: refs/heads/main"), (1, ".env", 404, "A=B"), (1, ".well-known/security.txt", 200, "Contact: x"), (2, ".well-known/security.txt", 404, None)], "id long, path string, status int, body string")
    assert {(r["id"], r["kind"]) for r in headers.exposure_findings(p, [(".git/HEAD", "^ref: ", "high"), (".env", "=", "high")]).collect()} == {(1, "served: .git/HEAD"), (2, "no security.txt")}


def _store(path):
    return KeyedStore(str(path), "k string, n long, label string, seen string, ts timestamp", ("k",), "ts", {"n": "sum", "label": "last", "seen": "first"}, 4)


def test_store_merges_in_any_order_and_replays(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "a", "b", "c", None]), 1, rng.choice("xyz"), rng.choice("pq"), T0 + datetime.timedelta(minutes=rng.randint(0, 50))) for _ in range(300)] + [("d", 5, None, "z", None)]
    parts = [rows[:100], rows[100:180], rows[180:]]
    seen = []
    for n, order in enumerate(itertools.permutations(range(3))):
        store = _store(tmp_path / str(n))
        for v, p in enumerate(order):
            b = spark.createDataFrame(parts[p], "k string, n long, label string, seen string, ts timestamp")
            store.put(b, v)
            if v == 1:
                store.put(b, v)  # as after a restart
        seen.append(sorted(map(str, store.read(spark).collect())))
    assert all(x == seen[0] for x in seen)
    got = {r["k"]: r for r in store.read(spark).collect()}
    for k in ("hot", "a", "b", "c"):
        mine = [r for r in rows if r[0] == k]
        assert got[k]["n"] == len(mine) and got[k]["label"] == max((r[4], r[2]) for r in mine)[1] and got[k]["seen"] == min((r[4], r[3]) for r in mine)[1]
    assert set(got) == {"hot", "a", "b", "c"} and store.read(spark, before=0).count() == 0


def test_store_deletes_and_expires(spark, tmp_path):
    store = _store(tmp_path / "s")
    make = lambda *rows: spark.createDataFrame([(k, n, k, k, T0 + datetime.timedelta(hours=h)) for k, n, h in rows], "k string, n long, label string, seen string, ts timestamp")
    store.put(make(("a", 1, 0), ("b", 2, 5), ("c", 3, 30)), 0)
    now = F.lit(T0 + datetime.timedelta(hours=30))
    assert {r["k"] for r in store.fresh(spark, now, 24 * 3600 + 3600).collect()} == {"b", "c"}
    store.delete(spark, F.col("label").isin("a", "b", "c") & (F.col("n") < 3), 1)
    assert {r["k"] for r in store.read(spark).collect()} == {"c"}
    store.delete(spark, F.lit(True), 2)
    assert store.read(spark).count() == 0
    store.put(make(("a", 7, 40)), 3)
    assert [(r["k"], r["n"]) for r in store.read(spark).collect()] == [("a", 7)]
    assert {r["k"] for r in store.read(spark, before=2).collect()} == {"c"}
    store.put(make(), 4)
    assert store.read(spark).count() == 1


def test_store_as_a_stream_sink(spark, tmp_path):
    schema = "k string, n long, label string, seen string, ts timestamp"
    store = _store(tmp_path / "s")
    for i in range(3):
        spark.createDataFrame([("a", 1, f"l{i}", f"s{i}", T0 + datetime.timedelta(days=i)), (f"k{i}", 1, None, None, T0)], schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    for i in range(3):
        q = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).writeStream.foreachBatch(store.sink()).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {r["k"]: (r["n"], r["label"], r["seen"]) for r in store.read(spark).collect()}
    assert got == {"a": (3, "l2", "s0"), "k0": (1, None, None), "k1": (1, None, None), "k2": (1, None, None)}


def test_campaigns_end_alike_in_any_order(spark, tmp_path):
    schema = "msg_id long, ts timestamp, verdict string, scam_type string, identity string, sender string, domains array<string>, share boolean"
    rows = [
        (1, T0, "scam", "bank", " North  Bank ", "+230 1", ["A.com"], True), (2, T0 + datetime.timedelta(hours=1), "scam", "parcel", "north bank", "[phone]", ["a.com ", ""], True),
        (3, T0, "safe", "bank", "North Bank", "x", [], True), (4, T0, "scam", "bank", None, "y", [], True), (5, T0, "scam", None, "Z", "y", [], True), (6, T0, "scam", "bank", "North Bank", "w", ["b.com"], False),
    ]
    batches = [spark.createDataFrame(x, schema) for x in (rows[:2], rows[2:4], rows[4:])]
    ends = []
    for n, order in enumerate(itertools.permutations(range(3))):
        c = Campaigns(str(tmp_path / str(n)), 2)
        for v, k in enumerate(order):
            c.record(batches[k], v)
        ends.append(sorted(map(tuple, c.known(spark).collect())))
    assert all(x == ends[0] for x in ends) and ends[0] == [("bank-unknown", 1, 1, 0), ("north-bank", 2, 1, 1)]
    assert {(r["msg_id"], r["match"], r["messages"]) for r in c.matches(batches[0], None).collect()} == {(1, "matched", 2), (2, "matched", 2)}
    assert {(r["msg_id"], r["match"]) for r in c.matches(batches[0], 0).collect()} == {(1, "new"), (2, "new")}
