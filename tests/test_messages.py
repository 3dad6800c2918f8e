"""Hosts, names, spelling, mail and the union of detectors: literal cases and brute force."""

from __future__ import annotations

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from tracewell.functions import hosts
from tracewell.operators import asof, containment, domains, edits, identity, lexicon, links, mail, offsets, spelling, workflows
from tracewell.plans import pipeline
from tracewell.plans.ruleset import ruleset
from tracewell.queries.pipeline import REGISTRY
from tracewell.sources import mail as mail_source

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("most", [0, 1, 2])
def test_similar_strings_equal_brute_force(spark, most):
    rng = random.Random(most)
    words = lambda n: ["".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) for _ in range(n)] + [None, "abc", "abc"]
    a, b = words(60), words(60)
    one = lambda x: spark.createDataFrame([(w,) for w in x], "w string")
    out = edits.similar(one(a), one(b), "w", most)
    want = {(x, y, lev(x, y)) for x in set(a) - {None} for y in set(b) - {None} if lev(x, y) <= most}
    assert {tuple(r) for r in out.collect()} == want
    assert not re.search("Cartesian|NestedLoop", plan_of(out))


def test_labels_within_allowed_edits(spark):
    rng = random.Random(9)
    official = ["mcb", "abcd", "abcde", "northbank", "telecomone", "postal", "averylongofficiallabel"]
    near = []
    for w in official * 12:
        w = list(w)
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randint(0, 1)] = rng.choice(["x", "", "ab"])
        near.append("".join(w))
    got = links.typos(spark.createDataFrame([(x,) for x in near], "label string"), spark.createDataFrame([(x,) for x in official], "label string"))
    allowed = lambda n: 0 if n <= 4 else 1 if n <= 8 else 2
    assert {tuple(r) for r in got.collect()} == {(a, b) for a in set(near) for b in official if lev(a, b) <= allowed(len(b))}


def test_techniques(spark):
    puny = "xn--" + "аspire".encode("punycode").decode()
    cases = {
        "aspire.mu": "same", "mail.aspire.mu": "same", "аspire.mu": "homoglyph", f"{puny}.mu": "homoglyph", "áspire.mu": "homoglyph", "a.spire.mu": "label_split", "a-spire.mu": "label_split",
        "aspire.mu.verify-login.com": "subdomain_abuse", "aspire.co": "tld_swap", "asp1re.mu": "confusable", "aspirre.mu": "typo", "aspire-login.com": "brand_embedded", "aspirepayroll.com": "brand_embedded", "other.org": None, "xn--zzzzz-.mu": None,
    }
    got = domains.relations(spark.createDataFrame([(x,) for x in cases], "host string"), spark.createDataFrame([("aspire.mu",)], "domain string"))
    assert {r["host"]: r["relation"] for r in got.collect()} == {k: v for k, v in cases.items() if v}
    assert not re.search("Cartesian|NestedLoop", plan_of(got))
    sibling = domains.relations(spark.createDataFrame([("pay.aspire.mu",)], "host string"), spark.createDataFrame([("mail.aspire.mu",)], "domain string")).first()
    assert sibling["relation"] == "sibling"
    kinds = spark.createDataFrame([("same",), ("sibling",), ("typo",), ("brand_embedded",), (None,)], "r string").select(domains.compared(F.col("r"))).collect()
    assert [r[0] for r in kinds] == ["same", "sibling", "lookalike", "different", "different"]
    sites = spark.createDataFrame([("dh.badssl.com", "badssl.com"), ("badssl.com.evil.net", "badssl.com"), (None, "x.com")], "a string, b string").select(hosts.same_site(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in sites] == [True, False, False]


def test_brands_trusted_and_shared_hosts(spark):
    one = lambda *x: spark.createDataFrame([(v,) for v in x], "domain string")
    brands = spark.createDataFrame([(0, "paypal.com"), (1, "microsoft.com")], "ord int, domain string")
    h = spark.createDataFrame([(x,) for x in ("paypa1.com", "micros0ft-login.com", "rnicrosoft.com", "paypall.com", "xaypal.com", "paypal.net", "www.paypal.com", "pay-pal.com")], "host string")
    got = {(r["host"], r["code"], r["official"]) for r in domains.brand_imitations(h, brands, h.where("false")).collect()}
    assert got == {("paypa1.com", "URL-01", "paypal.com"), ("micros0ft-login.com", "URL-02", "microsoft.com"), ("rnicrosoft.com", "URL-01", "microsoft.com"), ("paypall.com", "URL-01", "paypal.com"), ("pay-pal.com", "URL-01", "paypal.com")}
    h = spark.createDataFrame([("pay.google.com",), ("docs.google.com",), ("a.docs.google.com",), ("notgoogle.com",), ("x.github.io",)], "host string")
    assert {r["host"] for r in domains.trusted_hosts(h, one("google.com"), one("docs.google.com")).collect()} == {"pay.google.com"}
    assert {r["host"] for r in domains.shared_hosts(h, one("google.com"), one("docs.google.com"), one("github.io")).collect()} == {"pay.google.com", "docs.google.com", "a.docs.google.com", "x.github.io"}


def test_links_keep_disguised_hosts_and_skip_addresses(spark):
    m = spark.createDataFrame([(1, "see https://bank.com@evil.top/a, write to me@shop.com or shop.org.")], "msg_id long, text string")
    assert [(r["ord"], r["host"], r["user_info"]) for r in links.extract_links(m).orderBy("ord").collect()] == [(0, "evil.top", "bank.com"), (1, "shop.org", None)]


def test_calls_and_threats(spark):
    m = spark.createDataFrame([(1, "please log in at shop.org", "a.shop.org"), (2, "please log in at shop.org", None), (3, "log in at good.mu", None), (4, "see shop.org", None)], "msg_id long, text string, page_host string")
    l = links.extract_links(m)
    official, none = spark.createDataFrame([("good.mu",)], "domain string"), l.select("host").where("false")
    assert [tuple(r) for r in links.unofficial_calls(m, l, official, none).collect()] == [(2, "shop.org", "log in")]
    l = links.extract_links(spark.createDataFrame([(1, "https://docs.x.com/bad/1 https://docs.x.com/ok https://evil.top/any https://good.mu/x")], "msg_id long, text string"))
    listed = spark.createDataFrame([("docs.x.com", "/bad"), ("docs.x.com", ""), ("evil.top", "/page"), ("good.mu", "")], "host string, path string")
    hits = links.threat_hits(l, listed, spark.createDataFrame([("docs.x.com",)], "host string"), official)
    assert {(r["ord"], r["host"]) for r in hits.collect()} == {(0, "docs.x.com"), (2, "evil.top")}


def test_claims_and_contradictions(spark):
    texts = ["From: Shop. Hello", "send it here: 5900 0012 now", "reply on +230 5900 0012", "nothing", "Post Office and North Bank", None]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "msg_id long, text string")
    got = d.select(identity.observed_sender(F.col("text")), identity.claimed(F.col("text"), REGISTRY)).collect()
    assert [r[0] for r in got] == ["Shop", "5900 0012", "+230 5900 0012", None, None, None] and [r[1] for r in got] == [None, None, None, None, 1, None]
    names = spark.createDataFrame([("North Bank Ltd", "north bank"), ("John Smith", "Smith & Co"), ("John Smith", "Acme Ltd"), ("Ltd", "Acme"), ("North Bank", "Tax Office shop")], "a string, b string")
    assert [r[0] for r in names.select(identity.names_match(F.col("a"), F.col("b"), REGISTRY)).collect()] == [True, True, False, True, False]
    m = spark.createDataFrame([(1, "x", 0), (2, "pay to Mary Jane now", 0), (3, "pay to North Bank", 0)], "msg_id long, text string, claim int")
    l = spark.createDataFrame([(1, 0, "bit.ly", "bit.ly"), (1, 1, "a.northbank.com", "u1"), (1, 2, "evil.top", "u2"), (1, 3, "worse.top", "u3")], "msg_id long, ord long, host string, url string")
    assert {tuple(r) for r in identity.contradictions(m, l, REGISTRY).collect()} == {(1, 0, "ID-01", "evil.top", "u2"), (2, 1, "ID-02", None, "Mary Jane")}
    assert {r["code"] for r in identity.payment_signals(spark.createDataFrame([(1, "crypto", "John", "Acme", True), (2, None, None, "Acme", None)], "msg_id long, method string, recipient string, organisation string, on_call boolean"), REGISTRY).collect()} == {"PAY-02", "PAY-05", "PAY-06"}


def test_union_checks_codes(spark):
    rows = spark.createDataFrame([(1, 3, "URL-01", "a.b"), (1, 0, "URL-05", None)], "msg_id long, place long, code string, host string")
    extra = spark.createDataFrame([(1, 0, "NOPE-1", "rule"), (1, 0, "DOC-09", "semantic_model"), (1, 0, "DOC-09", "rule")], "msg_id long, place long, code string, source_type string")
    kept = pipeline.accepted(extra, ruleset())
    s = pipeline.union({"urls": rows, "extra": kept})
    assert [r["code"] for r in s.orderBy("ord").collect()] == ["URL-05", "URL-01", "DOC-09"]
    assert pipeline.checked(s, ruleset()).count() == 3
    with pytest.raises(Exception, match="unknown signal"):
        pipeline.checked(pipeline.union({"urls": extra.where("code = 'NOPE-1'")}), ruleset()).collect()
    stages = spark.createDataFrame([(["PAY-01", "SEC-01"],), (["SEC-02"],), (["EMAIL-07"],), (["URL-01"],), ([],)], "c array<string>").select(pipeline.stage(F.col("c"))).collect()
    assert [r[0] for r in stages] == ["OTP_REQUEST", "CREDENTIAL_REQUEST", "PAYMENT_REQUEST", None, None]


def test_workflows(spark):
    flows = [workflows.Workflow("a", ["X-1", "X-2:v"], ["Y-1", "Y-2:w"]), workflows.Workflow("b", ["X-2"], owner="o", approvals=2)]
    s = spark.createDataFrame([(1, "X-1", None), (1, "Y-2", "w"), (1, "X-1", None), (2, "X-2", "v"), (2, "Y-2", "z"), (3, "X-2", ""), (4, "X-2", None)], "msg_id long, code string, variant string")
    levels = spark.createDataFrame([(1, "high"), (2, "elevated"), (3, "critical"), (4, "low")], "msg_id long, level string")
    got = {(r["msg_id"], r["workflow"], r["triggered_by"]) for r in workflows.plan(s, levels, flows).collect()}
    assert got == {(1, "a", "X-1"), (2, "b", "X-2"), (3, "b", "X-2")}


def test_names_in_texts_equal_brute_force(spark):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(["a", "b", "é", "C-d", "a"]) for _ in range(n))
    texts = [(i, text(rng.randint(0, 12))) for i in range(40)] + [(90, None)]
    names = [(i, text(rng.randint(1, 3))) for i in range(25)] + [(80, ""), (81, None), (82, "zz")]
    t, n = spark.createDataFrame(texts, "text_id long, text string"), spark.createDataFrame(names, "name_id long, name string")
    words = lambda x: [w for w in re.split("[^a-z0-9]+", (x or "").lower().replace("é", "e")) if w]
    want = {(i, j, k) for i, x in texts for j, y in names for k in range(len(words(x))) if words(y) and words(x)[k : k + len(words(y))] == words(y)}
    assert {tuple(r) for r in containment.names_in(t, n).collect()} == want
    every = {(i, j) for i, x in texts for j, y in names if len(set(words(y))) >= 2 and set(words(y)) <= set(words(x))}
    assert {tuple(r) for r in containment.all_words_in(t, n).collect()} == every


def test_last_before_equals_brute_force(spark):
    rng = random.Random(6)
    events = [("hot" if rng.random() < 0.6 else rng.choice("ab"), rng.randint(0, 60), rng.randint(0, 9)) for _ in range(150)] + [(None, 3, 1), ("a", None, 1)]
    rows = [(i, rng.choice(["hot", "a", "b", "c", None]), rng.choice([None, *range(-5, 70)])) for i in range(120)]
    got = asof.last_before(spark.createDataFrame(rows, "id long, k string, t long"), spark.createDataFrame(events, "k string, t long, v long"), "k", "t", F.col("v"), "last", 7.0).collect()
    want = {}
    for i, k, t in rows:
        past = [(e[1], e[2]) for e in events if e[0] is not None and e[0] == k and e[1] is not None and t is not None and e[1] < t]
        want[i] = max(past)[1] if past else None
    assert {r["id"]: r["last"] for r in got} == want and len(got) == len(rows)


def test_offset_maps(spark):
    rng = random.Random(7)

    def runs(text):
        out, k = [], 0
        while k < len(text):
            n = rng.randint(1, 3)
            was = text[k : k + n]
            out.append((was, was if rng.random() < 0.6 else "".join(rng.choice("XYZ") for _ in range(rng.randint(0, 4)))))
            k += n
        return out

    rows = []
    for i in range(40):
        a = "".join(rng.choice("abcdef") for _ in range(rng.randint(0, 15)))
        first = runs(a)
        b = "".join(x for _, x in first)
        rows.append((i, a, [(w, n, w != n) for w, n in first], [(w, n, w != n) for w, n in runs(b)]))
    kind = "array<struct<was:string,now:string,replaced:boolean>>"
    d = spark.createDataFrame(rows, f"id long, a string, r1 {kind}, r2 {kind}")
    d = offsets.computed(d, inner=offsets.from_runs(F.col("r1")), outer=offsets.from_runs(F.col("r2")), c=offsets.rewritten(F.col("r2")))
    d = offsets.computed(d, both=offsets.composed(F.col("outer"), F.col("inner"), F.length("a")), back=offsets.inverse(F.col("inner")))
    places = F.transform(F.sequence(F.lit(0), F.greatest(F.length("c") - 1, F.lit(0))), lambda k: offsets.to_original(F.col("both"), k, k + 1, F.length("a")))
    for r in d.withColumn("places", places).collect():
        o1 = [k for k, s in enumerate(r["inner"]) for _ in range(s["n_len"])]
        o2 = [k for k, s in enumerate(r["outer"]) for _ in range(s["n_len"])]
        assert [s["o"] for s in r["back"]] == [s["n"] for s in r["inner"]]
        for k in range(len(r["c"])):
            s = r["outer"][o2[k]]
            mid = range(s["o"], s["o"] + s["o_len"]) if s["replaced"] else [s["o"] + k - s["n"]]
            ends = []
            for m in mid:
                t = r["inner"][o1[m]]
                ends += [t["o"], t["o"] + t["o_len"]] if t["replaced"] else [t["o"] + m - t["n"], t["o"] + m - t["n"] + 1]
            if ends:
                assert (r["places"][k]["start"], r["places"][k]["end"]) == (min(ends), max(ends)), (r["id"], k)


def test_respelling(spark):
    cases = {
        "Ou'nn gagn enn mesaz": "Ou finn gagn enn mesaz",
        "Mo INN gagn NU larzan": "Mo FINN gagn NOU larzan",
        "hello nu friend": "hello nu friend",
        "Pa partaz pu kod, pann gagn": "Pa partaz pou kod, pann gagn",
        "kont bloké, klik www.pu-nu.com": "kont bloke, klik www.pu-nu.com",
        "": "",
    }
    got = spelling.respelled(spark.createDataFrame([(x,) for x in cases], "text string")).collect()
    assert {r["text"]: r["normal"] for r in got} == cases
    found = spark.createDataFrame([("Pay Rs 5,000 on 2024-01-02 at www.shop.com/a. or mail a@b.co, call +230 5900 1234, code 12 34 56, e.g. @someone_x",)], "text string").select(F.transform(spelling.entities(F.col("text")), lambda e: F.concat(e["kind"], F.lit("="), e["found"]))).first()[0]
    assert found == ["amount=Rs 5,000", "date=2024-01-02", "url=www.shop.com/a", "email=a@b.co", "phone=+230 5900 1234", "number=12 34 56", "username=@someone_x"]
    mix = spark.createDataFrame([("ou kont bloke please verify your account now",), ("hello the account",), ("zzz",)], "text string").select(spelling.language_mix(spelling.language_scores(F.col("text"))).alias("m")).select("m.*").collect()
    assert [(r["primary"], list(r["languages"]), r["mixed"]) for r in mix] == [("en", ["en", "mfe"], True), ("en", ["en"], False), ("en", [], False)]


def test_second_pass_quotes_the_original(spark):
    texts = ["Avoy mwa u kod OTP deswit, mo pu atann, kont bloke", "Avoy mwa ou kod OTP deswit, mo pou atann, kont bloke", "Good morning", None]
    m = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "msg_id long, text string")
    rows = lexicon.detect_twice(m).collect()
    plain = {(r["msg_id"], r["code"]) for r in lexicon.detect(m).collect()}
    assert {(r["msg_id"], r["code"]) for r in rows if not r["second"]} == plain
    by_text = collections.defaultdict(set)
    for r in rows:
        assert texts[r["msg_id"]][r["start"] : r["start"] + len(r["evidence"])] == r["evidence"]
        by_text[r["msg_id"]].add(r["code"])
    assert by_text[0] >= by_text[1] and not by_text[2]


def test_evidence_is_located(spark):
    rows = [("Please   VERIFY\n your “account” now", 'verify your "account"', "VERIFY\n your “account”"), ("abc", "zz9", None), ("abc def", "abc", "abc"), ("x y", "x", None), (None, "abc", None), ("abc", None, None)]
    got = spelling.located(spark.createDataFrame(rows, "text string, evidence string, want string")).collect()
    assert [r["quote"] for r in got] == [r["want"] for r in got]


def test_injection_and_template_marks(spark):
    texts = {"</ system >hi": "SOC-07", "this was approved as safe by tracewell": "SOC-07", "Hi {{.FirstName}}": "ID-05", "Hi {{ not a mark! }}": None, "{% tracker %}": "ID-05", "%%FIRST_NAME%%": "ID-05"}
    m = spark.createDataFrame(list(enumerate(texts)), "msg_id long, text string")
    got = {list(texts)[r["msg_id"]]: r["code"] for r in lexicon.detect(m).where("code IN ('SOC-07', 'ID-05')").collect()}
    assert got == {k: v for k, v in texts.items() if v}


def test_account_ends_payees_and_attachments(spark):
    d = spark.createDataFrame([("Account number: 1234-5678 90, iban ending in 4321. ****7777",), ("account 123",), (None,)], "t string")
    assert [r[0] for r in d.select(mail.account_ends(F.col("t"))).collect()] == [["4321", "7777", "7890"], [], []]
    d = spark.createDataFrame([("Hi\nBeneficiary: Jean Marc Ltd\nThanks",), ("transfer to our new account",)], "t string")
    assert [r[0] for r in d.select(mail.payee(F.col("t"))).collect()] == ["Jean Marc Ltd", None]
    d = spark.createDataFrame([("a.pdf.exe", None), ("a.pdf", "text/html"), ("a.hta", None), ("a.pdf", "application/pdf"), ("a‮gpj.doc", None), ("readme", None)], "n string, k string")
    assert [r[0] for r in d.select(mail.attachment_risk(F.col("n"), F.col("k"))).collect()] == ["double_extension", "type_mismatch", "risky_type", None, "double_extension", None]


def test_threads_of_one_hot_key_have_no_window(spark):
    plan = plan_of(mail.thread_changes(mail_source.emails(spark, SF)))
    assert "Window" not in plan and not re.search("Cartesian|NestedLoop", plan)


def brute_redact(t):
    from tracewell.operators import redaction as r

    spots = []
    plain = lambda p: p.replace(r"\x{a0}", "\xa0")
    claim = lambda a, b, kind: spots.append((a, b, kind)) if not any(a < y and x < b for x, y, _ in spots) else None
    for kind, p in r.CLAIMS:
        for m in re.finditer(plain(p), t):
            if kind != "account" or len(re.sub(r"\D", "", m[0])) >= 8:
                claim(*m.span(), kind)
    for m in re.finditer(r.DIGITS, t):
        n = len(re.sub(r"\D", "", m[0]))
        before, after = t[max(0, m.start() - 32) : m.start()], t[m.end() : m.end() + 32]
        far = lambda w: min([len(before) - x.end() for x in re.finditer(w, before)] + [x.start() for x in re.finditer(w, after)], default=99)  # noqa: B023, E731
        code, account, phone = map(far, (r.CODE_WORDS, r.ACCOUNT_WORDS, r.PHONE_WORDS))
        near = min(code, account, phone)
        kind = None if n < 6 else "account" if n >= 9 or (near < 99 and account == near) else None if near < 99 and code == near else "phone" if n in (7, 8) else None
        if kind:
            claim(*m.span(), kind)
    out, at, names = "", 0, {}
    for a, b, kind in sorted(s for s in spots if s[2]):
        x = t[a:b]
        if x not in names:
            k = sum(v[0] == kind for v in names.values()) + 1
            digits = re.sub(r"\D", "", x)
            tail = digits[-4:] if len(digits) >= 4 else re.sub(r"\s", "", x)[-4:]
            name = f"[email {k}]@{x.rsplit('@', 1)[1]}" if kind == "email" else f"[phone {k}]" if kind == "phone" else f"[account ending {tail}]"
            if name in {v[1] for v in names.values()} and kind == "account":
                name = f"[account {k} ending {tail}]"
            names[x] = (kind, name)
        out, at = out + t[at:a] + names[x][1], b
    return out + t[at:]


def test_redaction_equals_brute_force(spark):
    from tracewell.operators import redaction

    texts = [
        "Call 52512345 to get your code, OTP is 52512345. Mail me@shop.mu or me@shop.mu", "account 123456 and 9999123456, card 1111 2222 3333 4444; ending 8888123456", "Rs 5,000 on 22/09/2026 at https://x.mu/12345678 or y.com/99999999",
        "MU17 BOMM 0101 1010 3030 0200 000M UR, +230 5251 2345 and (00230)5251234", "ref 123456 and 1234567 and 12345678 and ABC1234567", None, "", "code 1234567 phone 7654321 a/c 7654322",
    ]
    rng = random.Random(5)
    words = ["account", "code", "call", "1234567", "12345678", "999888777", "Rs", "5,000", "12.50", "a@b.co", "x.mu", "+230", "5251", "2345", "kont", "MU17BOMM0101101030300200", "é", "-"]
    texts += [rng.choice([" ", "  ", ", "]).join(rng.choice(words) for _ in range(rng.randint(1, 14))) for _ in range(150)]
    d = redaction.redact_all(spark.createDataFrame([(x,) for x in texts], "text string"))
    for r in d.withColumn("back", redaction.restored(F.col("redacted"), F.col("redactions"))).collect():
        assert r["redacted"] == brute_redact(r["text"] or ""), r["text"]
        assert r["back"] == (r["text"] or "")


def test_certificates_ages_and_forms(spark):
    from tracewell.operators import urls

    d = spark.createDataFrame([(1, 9, False, True, True, None), (1, 4, False, True, True, None), (6, 9, False, True, True, None), (1, 9, True, True, False, "X"), (1, 9, False, False, True, None), (1, 9, False, True, False, "X"), (1, 9, False, True, False, "UNABLE_TO_GET_ISSUER_CERT"), (1, 9, False, True, None, None)], "a int, b int, s boolean, c boolean, z boolean, e string")
    got = [r[0] for r in d.select(urls.certificate_problem(*map(F.col, "abscze"), F.lit(5))).collect()]
    assert got == [None, "expired", "not_yet_valid", "self_signed", "wrong_host", "untrusted", None, "untrusted"]
    d = spark.createDataFrame([(3, None), (10, 1), (40, 1), (None, 1), (None, 40), (None, None)], "d int, c int")
    assert [r[0] for r in d.select(urls.age_signal(F.col("d"), F.col("c"))).collect()] == ["high", "medium", None, "medium", None, None]
    d = spark.createDataFrame([(["1.2"], None), ([], "Org"), ([], ""), (None, None)], "p array<string>, o string")
    assert [r[0] for r in d.select(urls.certificate_kind(F.col("p"), F.col("o"), ["1.2"])).collect()] == ["EV", "OV", "DV", "DV"]
    rows = [(1, "bank.evil.top", 0, "steal.net", True, False), (1, "bank.evil.top", 0, "steal.net", False, True), (1, "bank.evil.top", 0, None, True, False), (1, "bank.evil.top", 0, "a.northbank.com", True, False), (2, "www.northbank.com", 0, "steal.net", True, False), (3, "x.org", None, "y.org", True, True), (4, "x.org", 0, "ok.example.org", True, False), (5, "x.org", 0, "y.org", False, False)]
    forms = spark.createDataFrame(rows, "page_id long, page_host string, claim int, action_host string, has_password boolean, has_card boolean")
    got = urls.form_signals(forms, REGISTRY, spark.createDataFrame([("ok.example.org",)], "host string")).collect()
    assert [tuple(r) for r in got] == [(1, "URL-10", "steal.net", "card,password")]
