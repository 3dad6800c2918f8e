"""Numbered placeholders for personal identifiers, and language mix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators import offsets

# Kinds in order of precedence, and marker words, of the short forms below.
EMAIL = r"[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}"
PHONE = r"\(?(?:\+|00)230\)?[\s.-]?[0-9](?:[\s.-]?[0-9]){6,7}"
ACCOUNT = r"\b[0-9]{9,}\b"
MARKERS = {
    "en": ["the", "and", "your", "you", "is", "to", "please", "account", "with"],
    "fr": ["le", "la", "les", "votre", "vous", "est", "et", "de", "compte", "sur"],
    "mfe": ["ou", "mwa", "pou", "enn", "dan", "bizin", "kont", "avoy", "personn"],
}

# Results depend on them. Kinds claim their matches in this order; null ones protect what must stay.
_B, _E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
_WORD = r"(?:Rs\.?|MUR|EUR|USD|GBP|roupies?|rupees?|rupi)"
_SUM = r"(?:\d{1,3}(?:[ ,.\x{a0}]\d{3})+(?:[.,]\d{1,2})?|\d+(?:[.,]\d{1,2})?)(?!\d)"
CLAIMS = [
    ("email", rf"[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{{2,24}}{_E}"),
    (None, rf"{_B}(?:https?://|www\.)[^\s<>\"']+|{_B}(?:[A-Za-z0-9](?:[A-Za-z0-9-]{{0,61}}[A-Za-z0-9])?\.)+[A-Za-z]{{2,24}}{_E}(?:/[^\s<>\"']*)?"),
    (None, rf"(?i)(?<![A-Za-z]){_WORD}\s?{_SUM}|[€$£]\s?{_SUM}|(?<![A-Za-z0-9_.,]){_SUM}\s?(?:{_WORD}|[€$£])(?![A-Za-z])|(?<!\d)\d{{1,3}}(?:,\d{{3}})+(?:\.\d{{1,2}})?(?!\d)|(?<![\d.,])\d+[.,]\d{{2}}(?!\d)"),
    (None, r"(?<!\d)\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}(?!\d)"),
    ("account", rf"{_B}[A-Z]{{2}}\d{{2}}(?:[ ]?[A-Z0-9]){{11,30}}{_E}"),
    ("phone", r"\(?(?:\+|00)230\)?[\s.-]?\d(?:[\s.-]?\d){6,7}(?!\d)"),
]
#: Digits in groups, whose kind follows from their number and the nearest of these words.
DIGITS = rf"{_B}\d+(?:[ -]\d+)*{_E}"
CODE_WORDS = rf"(?i){_B}(?:otp|code|codes|kod|pin|passcode|password|mot de passe|verification|vérification|verifikasion|token|cvv|secret){_E}"
ACCOUNT_WORDS = rf"(?i)(?:{_B}(?:account|acct|acc|compte|kont|card|carte|kart|iban|numero|numéro|nimero|ending){_E}|a/c)"
PHONE_WORDS = rf"(?i){_B}(?:call|calls|phone|tel|téléphone|telephone|telefonn|mobile|appelez|appeler|apel|whatsapp|contact|contactez|kontak){_E}"
CONTEXT = 32
#: Digits that an account in letters and digits must have.
MIN_ACCOUNT_DIGITS = 8
# End of the fixed values.

_SPOTS = "array<struct<start:int,end:int,found:string,kind:string>>"


def _digits(x: Column) -> Column:
    return F.length(F.regexp_replace(x, r"\D", ""))


def _nearest(before: Column, after: Column, words: str) -> Column:
    """Characters between a number and the nearest match of ``words`` in its context; null if there is none."""
    left = F.when(F.rlike(before, F.lit(words)), F.length(F.element_at(F.split(before, words, -1), -1)))
    right = F.when(F.rlike(after, F.lit(words)), F.length(F.element_at(F.split(after, words, -1), 1)))
    return F.least(left, right)


def _number_kind(text: Column, m: Column) -> Column:
    """account, phone or null (a code, or too short) of a run of digits."""
    before = F.substr(text, F.greatest(m["start"] - CONTEXT, F.lit(0)) + 1, F.least(m["start"], F.lit(CONTEXT)))
    after = F.substr(text, m["end"] + 1, F.lit(CONTEXT))
    code, account, phone = (_nearest(before, after, w) for w in (CODE_WORDS, ACCOUNT_WORDS, PHONE_WORDS))
    near, n = F.least(code, account, phone), _digits(m["found"])
    local = F.when(n.isin(7, 8), "phone")
    return F.when(n < 6, None).when(n >= 9, "account").when(near.isNull(), local).when(account == near, "account").when(code == near, None).otherwise(local)


def identifiers(text: Column) -> Column:
    """(start, end, found, kind) of emails, accounts and phones, in order of place.

    Links, amounts and dates claim their places besides, so nothing inside
    them is an identifier; the first kind to claim a place keeps it.
    """
    named = lambda found, kind: F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["found"].alias("found"), (F.lit(None).cast("string") if kind is None else F.lit(kind)).alias("kind")))
    groups = []
    for kind, pattern in CLAIMS:
        found = offsets.spans(text, pattern)
        if kind == "account":
            found = F.filter(found, lambda m: _digits(m["found"]) >= MIN_ACCOUNT_DIGITS)
        groups.append(named(found, kind))
    runs = F.transform(offsets.spans(text, DIGITS), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["found"].alias("found"), _number_kind(text, m).alias("kind")))
    groups.append(F.filter(runs, lambda m: m["kind"].isNotNull()))
    free = lambda claimed, m: ~F.exists(claimed, lambda c: offsets.overlaps(c, m))
    claimed = F.aggregate(F.array(*groups), F.array().cast(_SPOTS), lambda claimed, found: F.concat(claimed, F.filter(found, lambda m: free(claimed, m))))
    return F.array_sort(F.filter(claimed, lambda m: m["kind"].isNotNull()))


def _named(spots: Column) -> Column:
    """(original, kind, placeholder) of the distinct identifiers, in order; numbers count per kind, an account's last digits show unless they are taken."""
    kind_of = "array<struct<original:string,kind:string,placeholder:string>>"

    def step(a: Column, m: Column) -> Column:
        n = F.size(F.filter(a, lambda x: x["kind"] == m["kind"])) + 1
        digits = F.regexp_replace(m["found"], r"\D", "")
        tail = F.when(F.length(digits) >= 4, F.right(digits, F.lit(4))).otherwise(F.right(F.regexp_replace(m["found"], r"\s", ""), F.lit(4)))
        plain = F.concat(F.lit("[account ending "), tail, F.lit("]"))
        account = F.when(F.exists(a, lambda x: x["placeholder"] == plain), F.concat(F.lit("[account "), n.cast("string"), F.lit(" ending "), tail, F.lit("]"))).otherwise(plain)
        name = F.when(m["kind"] == "email", F.concat(F.lit("[email "), n.cast("string"), F.lit("]@"), F.substring_index(m["found"], "@", -1))).when(m["kind"] == "phone", F.concat(F.lit("[phone "), n.cast("string"), F.lit("]"))).otherwise(account)
        new = F.concat(a, F.array(F.struct(m["found"].alias("original"), m["kind"].alias("kind"), name.alias("placeholder"))))
        return F.when(F.exists(a, lambda x: x["original"] == m["found"]), a).otherwise(new)

    return F.aggregate(spots, F.array().cast(kind_of), step)


def redact_all(messages: DataFrame) -> DataFrame:
    """Adds redacted and redactions (original, kind, placeholder) to ``messages`` (column text).

    An identifier that comes again has the same placeholder. Null counts as
    empty. Work is per row; runs of digits are judged by the words around.
    """
    d = offsets.computed(messages.withColumn("_t", F.coalesce("text", F.lit(""))), _spots=identifiers(F.col("_t")))
    d = offsets.computed(d, redactions=_named(F.col("_spots")))
    starts = F.concat(F.array(F.lit(0)), F.transform("_spots", lambda s: s["end"]))
    ends = F.concat(F.transform("_spots", lambda s: s["start"]), F.array(F.length("_t")))
    gaps = F.zip_with(starts, ends, lambda a, b: F.substr(F.col("_t"), a + 1, b - a))
    marks = F.concat(F.transform("_spots", lambda s: F.get(F.filter("redactions", lambda r: r["original"] == s["found"]), F.lit(0))["placeholder"]), F.array(F.lit("")))
    return d.withColumn("redacted", F.array_join(F.zip_with(gaps, marks, lambda g, m: F.concat(g, m)), "")).drop("_t", "_spots")


def restored(text: Column, redactions: Column) -> Column:
    """The text with its placeholders as the originals again."""
    return F.aggregate(redactions, text, lambda t, r: F.replace(t, r["placeholder"], r["original"]))


def placeholders(messages: DataFrame) -> DataFrame:
    """msg_id, kind, original, number: distinct identifiers of a message in order of their first appearance, numbered per kind.

    An email, else an international phone, else a run of nine digits or more.
    """
    parts = [("email", EMAIL), ("phone", PHONE), ("account", ACCOUNT)]
    text, out = F.col("text"), []
    for kind, pattern in parts:
        found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
        out.append(F.transform(found, lambda x, i: F.struct(x.alias("original"), (i + 1).alias("number"))))
        text = F.regexp_replace(text, pattern, " ")
    rows = messages.select("msg_id", *[c.alias(k) for c, (k, _) in zip(out, parts, strict=True)])
    each = [rows.select("msg_id", F.lit(k).alias("kind"), F.explode(k).alias("x")) for k, _ in parts]
    return each[0].unionAll(each[1]).unionAll(each[2]).select("msg_id", "kind", "x.original", F.col("x.number").cast("long").alias("number"))


def redact(messages: DataFrame) -> DataFrame:
    """msg_id and the text with emails as [email], phones as [phone] and accounts as [account ending dddd]."""
    t = F.regexp_replace("text", EMAIL, "[email]")
    t = F.regexp_replace(t, PHONE, "[phone]")
    t = F.regexp_replace(t, r"\b[0-9]{5,}([0-9]{4})\b", "[account ending $1]")
    return messages.select("msg_id", t.alias("redacted"))


def language_mix(messages: DataFrame) -> DataFrame:
    """msg_id, primary language, its score, and whether another reaches 1.5: weighted marker words of each language.

    Markers of more than two letters weigh 1, shorter ones 0.5; ties go to the
    first of mfe, fr, en. A message without a marker is 'en' with score 0.
    """
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[a-zà-ÿ']+"), F.lit(0))
    score = {}
    for k, marks in MARKERS.items():
        long_, short = [m for m in marks if len(m) > 2], [m for m in marks if len(m) <= 2]
        score[k] = F.size(F.filter("w", _among(long_))) * 1.0 + F.size(F.filter("w", _among(short))) * 0.5
    t = messages.select("msg_id", words.alias("w")).select("msg_id", *[score[k].alias(k) for k in MARKERS])
    top = F.greatest(*MARKERS)
    primary = F.when((F.col("mfe") == top) & (top > 0), "mfe").when((F.col("fr") == top) & (top > 0), "fr").otherwise("en")
    strong = sum(((F.col(k) >= 1.5).cast("int") for k in MARKERS), F.lit(0))
    return t.select("msg_id", primary.alias("primary_lang"), top.alias("score"), (strong > 1).alias("mixed"))


def _among(words: list[str]):
    return lambda w: w.isin(words) if words else F.lit(False)
