"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

Only built-in expressions and small aggregations: texts never leave the JVM,
and only counts of vote and feature patterns reach the driver.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import folded, table, written

#: The base patterns, written so that each run of characters is scanned once:
#: a match begins where its run begins or where the last match ended, and
#: nothing is given back. The matches are those of the plain patterns.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What the method looks at besides: keyed credentials, written-out addresses, runs of seven or more digits.
CANDIDATE = "|".join([
    r"(?i:password|passwd|pwd|token|secret|api[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9+/_.-]{8,}+[\"']?",
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\s?(?:\(at\)|\[at\])\s?[A-Za-z0-9-]++\s?(?:\(dot\)|\[dot\]|\.)\s?[A-Za-z]{2,}+",
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![A-Za-z0-9])[+(]{0,2}[0-9](?:[ ().-]{0,2}[0-9]){6,}+",
])
KINDS = ("email", "ip", "card", "phone", "secret")
_SPAN = "struct<start:int,end:int,v:string>"


def _luhn(v: str) -> str:
    """SQL: whether the digits of v pass the Luhn test."""
    d = f"regexp_replace({v}, '[^0-9]', '')"
    return f"aggregate(transform(split(reverse({d}), ''), (c, i) -> IF(c = '', 0, IF(i % 2 = 0, int(c), int(c) * 2 - IF(int(c) > 4, 9, 0)))), 0, (a, x) -> a + x) % 10 = 0"


def _digits(v: str) -> str:
    return f"length(regexp_replace({v}, '[^0-9]', ''))"


def _octets(v: str) -> str:
    return f"forall(split({v}, '[.]'), o -> length(ltrim('0', o)) <= 3 AND coalesce(try_cast(right(o, 4) AS int), 999) <= 255)"


_KEEP = {"email": "true", "ip": _octets("x.v"), "card": f"{_digits('x.v')} BETWEEN 14 AND 19 AND {_luhn('x.v')}", "phone": f"{_digits('x.v')} BETWEEN 10 AND 15"}


def _positions(m: str, p: str) -> str:
    """SQL: spans of the matches m, by the lengths of matches and of the pieces p between them."""
    item = f"named_struct('start', s.k + length({p}[i - 1]), 'end', s.k + length({p}[i - 1]) + length({m}[i - 1]), 'v', {m}[i - 1])"
    return folded(f"size({m})", "0", f"s.k + length({p}[i - 1]) + length({m}[i - 1])", item, _SPAN)


def _matches(docs: DataFrame, patterns: dict[str, str], text: str) -> DataFrame:
    """Adds m_<kind> and p_<kind>: all matches, and the pieces between them."""
    t = F.col(text)
    none = F.array().cast("array<string>")
    hit = {k: F.when(F.rlike(t, F.lit(p)), F.regexp_extract_all(t, F.lit(p), F.lit(0))).otherwise(none) for k, p in patterns.items()}
    docs = docs.select("*", *[c.alias(f"m_{k}") for k, c in hit.items()])
    return docs.select("*", *[F.when(F.size(f"m_{k}") > 0, F.split(t, p, -1)).otherwise(none).alias(f"p_{k}") for k, p in patterns.items()])


#: The gazetteer, a table of a kind and an entry: what credentials are called, how domains end, which calling codes exist (E.164; all codes of some three-digit zones), and words before numbers that aren't personal. Callers may pass their own.
GAZETTEER: dict[str, tuple[str, ...]] = {
    "credential": ("password", "passwd", "pwd", "token", "secret", "apikey", "api_key", "api-key"),
    "ending": tuple("com org net edu gov mil int info biz io ai app dev co example test ac ad ae af ag al am ao ar at au az ba bd be bf bg bh bj bo br bw by bz ca cd cf cg ch ci cl cm cn cr cu cv cy cz de dj dk do dz ec ee eg es et eu fi fj fr ga gb ge gh gn gr gt hk hn hr ht hu id ie il in iq ir is it jm jo jp ke kg kh km kr kw kz lb li lk lr ls lt lu lv ly ma mc md me mg mk ml mm mn mr mt mu mv mw mx my mz na ne ng ni nl no np nz om pa pe ph pk pl pt py qa re ro rs ru rw sa sc sd se sg si sk sn so sv sy td tg th tn tr tt tz ua ug uk us uy uz ve vn ye za zm zw".split()),
    "calling": tuple("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()),
    "zone": tuple("21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 80 85 87 88 96 97 99".split()),
    "quantity": ("eur", "usd", "isbn", "doi", "version", "page", "chapter", "vol", "no", "$", "€", "£"),
}


def _listed_in(kind: str, value: str, gazetteer: dict[str, tuple[str, ...]]) -> str:
    """SQL: whether the gazetteer has the value as an entry of that kind."""
    entries = ", ".join("'" + e.replace("\\", "\\\\").replace("'", "\\'") + "'" for e in gazetteer.get(kind, ()))
    return f"array_contains(CAST(array({entries}) AS array<string>), {value})"


def _gazetteer(table: dict[str, tuple[str, ...]]) -> str:
    """SQL of the labeler that looks parts of a candidate up in the gazetteer."""
    name, ending, number = "lower(regexp_extract(x.v, '^[A-Za-z_-]+', 0))", "lower(regexp_extract(x.v, '[A-Za-z]+$', 0))", "regexp_replace(x.v, '[^0-9]', '')"
    before = "lower(regexp_extract(x.l, '([A-Za-z]+|[$€£])[.]?[ :]{0,2}$', 1))"
    calling = " OR ".join([*(_listed_in("calling", f"left({number}, {k})", table) for k in (1, 2)), _listed_in("zone", f"left({number}, 2)", table)])
    return f"CASE WHEN {_listed_in('credential', name, table)} THEN 1 WHEN x.v RLIKE '@|[(\\\\[]at[)\\\\]]' THEN IF({_listed_in('ending', ending, table)}, 1, -1) WHEN {_listed_in('quantity', before, table)} THEN 0 WHEN x.v LIKE '+%' THEN IF({calling}, 1, 0) ELSE -1 END"


#: Labelers: SQL over a candidate x (v: its text, l and r: what stands before and after) that gives 1 (personal), 0 (not) or -1 (no opinion).
LABELERS = {
    "shape": f"CASE WHEN x.v RLIKE '@|[(\\\\[]at[)\\\\]]' THEN 1 WHEN x.v RLIKE '^(?:19|20)[0-9]{{2}}[-. ][0-9]{{1,2}}[-. ][0-9]{{1,2}}$' THEN 0 WHEN x.v RLIKE '^[+][0-9]' THEN IF({_digits('x.v')} BETWEEN 10 AND 15, 1, 0) WHEN x.v RLIKE '^[0-9]+([.][0-9]+){{3}}$' THEN IF({_octets('x.v')}, 1, 0) WHEN x.v RLIKE '^[(]?[0-9]{{3}}[)]?[ .-][0-9]{{3}}[ .-][0-9]{{4}}$' THEN 1 WHEN x.v RLIKE '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' THEN 1 WHEN x.v RLIKE '^[0-9 -]+$' AND {_digits('x.v')} BETWEEN 14 AND 19 THEN IF({_luhn('x.v')}, 1, 0) WHEN x.v RLIKE '^[0-9]+$' THEN 0 ELSE -1 END",
    "gazetteer": _gazetteer(GAZETTEER),
    "context": "CASE WHEN x.l RLIKE '(?i)(?:call|phone|tel|mobile|contact|reach|fax|mail|card|account|iban|ssn|host|server|ip)[ :.#]{1,3}$' THEN 1 WHEN x.r RLIKE '(?i)^ ?(?:%|km|kg|people|years|euros?|items|dollars)' THEN 0 ELSE -1 END",
    "entropy": "CASE WHEN x.v RLIKE '[0-9a-f]{16}' AND x.v RLIKE '[a-f]' AND x.v RLIKE '[0-9]' THEN 1 WHEN x.v RLIKE '^[0-9]{20,}' THEN 0 ELSE -1 END",
}
#: What the span classifier sees: SQL over the same candidate that gives true or false.
FEATURES = {
    "at": "x.v RLIKE '@|[(\\\\[]at[)\\\\]]'",
    "plus": "x.v LIKE '+%'",
    "keyed": "x.v RLIKE '^[A-Za-z_-]+[\"'' ]{0,4}[=:]'",
    "hex": "x.v RLIKE '[0-9a-f]{16}' AND x.v RLIKE '[a-f]'",
    "grouped": "x.v RLIKE '[0-9][ ().-]+[0-9]'",
    "phone_like": f"{_digits('x.v')} BETWEEN 10 AND 13",
    "checked": f"{_digits('x.v')} BETWEEN 14 AND 19 AND {_luhn('x.v')}",
    "cue": "x.l RLIKE '(?i)(?:call|phone|tel|mobile|contact|fax|mail|card|account|iban|ssn)[ :.#]{1,3}$'",
}


def _codes(gazetteer: dict[str, tuple[str, ...]]) -> tuple[str, str]:
    """SQL for the votes as one number in base 3, and for the features as one in base 2."""
    labelers = LABELERS | {"gazetteer": _gazetteer(gazetteer)}
    votes = " + ".join(f"(({q}) + 1) * {3**i}" for i, q in enumerate(labelers.values()))
    feats = " + ".join(f"IF({q}, {2**i}, 0)" for i, q in enumerate(FEATURES.values()))
    return votes, feats


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, gazetteer: dict[str, tuple[str, ...]] = GAZETTEER) -> DataFrame:
    """Per row: ``id``, ``base`` (spans of the four base kinds, sorted), ``cand`` (candidates with votes and features); and the columns ``keep``."""
    votes, feats = _codes(gazetteer)
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("txt"), *[F.col(c).alias(f"kept_{c}") for c in keep or []])
    names = [c for c in d.columns if c != "txt"]
    d = _matches(d, BASE | {"cand": CANDIDATE}, "txt")
    spans = [F.expr(_positions(f"m_{k}", f"p_{k}")).alias(f"s_{k}") for k in (*BASE, "cand")]
    d = d.select(*names, "p_cand", *spans)
    tagged = [f"transform(filter(s_{k}, x -> {_KEEP[k]}), x -> named_struct('start', x.start, 'k', {i}, 'end', x.end))" for i, k in enumerate(BASE)]
    around = "transform(s_cand, (y, j) -> named_struct('start', y.start, 'end', y.end, 'v', y.v, 'l', right(p_cand[j], 24), 'r', left(p_cand[j + 1], 12)))"
    d = d.select(*names, F.expr(f"sort_array(concat({', '.join(tagged)}))").alias("base"), F.expr(around).alias("around"))
    kind = "CASE WHEN x.v RLIKE '^[A-Za-z_-]+[\"'' ]{0,4}[=:]' THEN 4 WHEN x.v RLIKE '@|[(\\\\[]at' THEN 0 ELSE 3 END"
    return d.select(*names, "base", F.expr(f"transform(around, x -> named_struct('start', x.start, 'k', {kind}, 'end', x.end, 'votes', {votes}, 'feats', {feats}))").alias("cand"))


def estimate(patterns: list[tuple[int, int]], rounds: int = 50) -> dict[int, float]:
    """Probability of being personal for each vote pattern, by EM.

    ``patterns`` has (votes, count). Each labeler has a rate of each vote
    given the class, smoothed; the start trusts the votes. The number of
    patterns is bounded by 3 to the number of labelers.
    """
    m = len(LABELERS)
    vote = lambda code, i: code // 3**i % 3  # noqa: E731  0: no opinion, 1: not, 2: personal
    post = {}
    for code, _ in patterns:
        yes, no = sum(vote(code, i) == 2 for i in range(m)), sum(vote(code, i) == 1 for i in range(m))
        post[code] = (yes + 0.5) / (yes + no + 1)
    for _ in range(rounds):
        total = sum(n for _, n in patterns)
        mass = sum(post[c] * n for c, n in patterns)
        prior = (mass + 1) / (total + 2)
        rate = [[[1.0 if (v == 0 or (v == 2) == bool(y)) else 0.2 for v in range(3)] for y in (0, 1)] for _ in range(m)]
        for code, n in patterns:
            for i in range(m):
                rate[i][1][vote(code, i)] += post[code] * n
                rate[i][0][vote(code, i)] += (1 - post[code]) * n
        new = {}
        for code, _ in patterns:
            odds = log(prior) - log(1 - prior)
            for i in range(m):
                v = vote(code, i)
                odds += log(rate[i][1][v] / sum(rate[i][1])) - log(rate[i][0][v] / sum(rate[i][0]))
            new[code] = 1 / (1 + exp(-max(-30.0, min(30.0, odds))))
        moved = max((abs(new[c] - post[c]) for c in new), default=0)
        post = new
        if moved < 1e-6:
            break
    return post


def train_classifier(rows: list[tuple[int, float, int]], rounds: int = 400, l2: float = 0.01) -> list[float]:
    """Logistic weights (bias first) for (features, probability, count) rows, by gradient steps over the distinct patterns."""
    m, total = len(FEATURES), sum(n for _, _, n in rows) or 1
    w = [0.0] * (m + 1)
    for _ in range(rounds):
        g = [l2 * x for x in w]
        for code, target, n in rows:
            on = [0, *(i + 1 for i in range(m) if code >> i & 1)]
            gap = (1 / (1 + exp(-max(-30.0, min(30.0, sum(w[i] for i in on))))) - target) * n / total
            for i in on:
                g[i] += gap
        w = [x - 2.0 * y for x, y in zip(w, g, strict=True)]
    return w


def fit(found: DataFrame) -> list[float]:
    """Classifier weights from find_spans() output: pattern counts over all candidates, EM, then regression on its posteriors."""
    counts = found.select(F.explode("cand").alias("c")).groupBy("c.votes", "c.feats").agg(F.count("*").alias("n")).orderBy("votes", "feats").collect()
    by_votes: dict[int, int] = {}
    for r in counts:
        by_votes[r["votes"]] = by_votes.get(r["votes"], 0) + r["n"]
    post = estimate(sorted(by_votes.items()))
    return train_classifier([(r["feats"], post[r["votes"]], r["n"]) for r in counts])


def decided(weights: list[float], threshold: float = 0.5) -> Column:
    """All spans (start, k, end): the base ones, and candidates beyond the threshold that touch no base span."""
    score = f"{weights[0]!r}D" + "".join(f" + IF(shiftright(c.feats, {i}) & 1 = 1, {w!r}D, 0D)" for i, w in enumerate(weights[1:]))
    cut = log(threshold / (1 - threshold))
    more = f"transform(filter(cand, c -> {score} > {cut!r}D AND NOT exists(base, b -> b.start < c.end AND c.start < b.end)), c -> named_struct('start', c.start, 'k', c.k, 'end', c.end))"
    return F.expr(f"sort_array(concat(base, {more}))")


def _listed(spans: str) -> str:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({spans}, x -> concat({names}[x.k], ':', x.start, ':', x.end)), ',')"


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, threshold: float = 0.5, gazetteer: dict[str, tuple[str, ...]] = GAZETTEER) -> DataFrame:
    """Per row of ``docs``: id, ``base`` and ``spans``, arrays of (start, k, end) in code points, end exclusive, k an index into KINDS; and the columns ``keep``.

    Null and empty texts have none; rows are independent, so repeated rows and
    null ids are kept as they are; a span of any length in a text of any
    length is found whole; where candidates touch, the one that begins first
    counts; other columns are not read.
    """
    found = written(find_spans(docs, id_col, text_col, keep, gazetteer), "pii-found")
    out = found.withColumn("spans", decided(fit(found), threshold))
    return out.select(F.col("id").alias(id_col), "base", "spans", *[F.col(f"kept_{c}").alias(c) for c in keep or []])


def redacted(text: str, spans: str) -> Column:
    """The text with each stretch that spans cover replaced by its first span's kind, as <EMAIL>."""
    names = "array(" + ", ".join(f"'<{k.upper()}>'" for k in KINDS) + ")"
    # Where a span begins inside what the ones before it cover, only its end counts.
    item = f"concat(substring({text}, s.k + 1, greatest({spans}[i - 1].start - s.k, 0)), IF({spans}[i - 1].start >= s.k, {names}[{spans}[i - 1].k], ''))"
    pieces = folded(f"size({spans})", "0", f"greatest(s.k, {spans}[i - 1].end)", item, "string")
    return F.expr(f"IF(size({spans}) = 0, {text}, concat(array_join({pieces}, ''), substring({text}, array_max(transform({spans}, x -> x.end)) + 1)))")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with all spans in the text replaced by their kinds; other columns stay."""
    found = detect(docs, id_col, text_col, docs.columns, threshold)
    # The id appears twice: under its own name and among the kept columns.
    found = found.toDF("__id", *found.columns[1:])
    spans = found.withColumn("__text", F.coalesce(F.col(text_col), F.lit("")))
    return spans.select(*[F.when(F.col(c).isNotNull(), redacted("__text", "spans")).alias(c) if c == text_col else F.col(c) for c in docs.columns])


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents"))
    n = [F.expr(f"size(filter(base, x -> x.k = {i}))").cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)]
    return found.select("doc_id", *n, F.sha2(F.expr(_listed("base")).cast("binary"), 256).alias("base_sha256"), F.expr(_listed("spans")).alias("spans"))
