"""Who a message claims to be from, and what contradicts the claim."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import hosts as h
from tracewell.functions import text as t

# Results depend on them.
#: A labelled sender line, else the number that money or replies go to.
SENDER_LINE = r"(?im)^(?:from|sender|de|exp[ée]diteur)\s*:\s*([^\n]{1,60}?)(?:\.\s|\n|\z)"
SEND_TO = r"(?i)\b(?:send|pay|transfer)(?:\s+it|\s+this|\s+the\s+(?:money|amount|payment))?\s+(?:here|to|on|at)\s*:?\s*([+\d][\d\s-]{4,17}\d)\b"
REPLY_ON = r"(?i)\breply\s+(?:here|to|on)\s*:?\s*([+\d][\d\s-]{4,17}\d)\b"
_NAME_WORD = r"(?!to\b|now\b|today\b|please\b|immediately\b|urgently\b)[a-z][a-z'-]*"
#: Who gets the money.
BENEFICIARY = [
    rf"(?i)(?:beneficiary|recipient|payee|b[ée]n[ée]ficiaire)\s*[:\-]?\s*(?!https?:)({_NAME_WORD}(?:\s+{_NAME_WORD}){{0,3}})",
    rf"(?i)(?:pay(?:ment)?|transfer|send(?:\s+the)?(?:\s+money)?|envoyer|payer)\s+(?:to|à)\s+(?!https?:)({_NAME_WORD}(?:\s+{_NAME_WORD}){{0,3}})",
]
NAME_STOPWORDS = ["ltd", "limited", "co", "company", "inc", "plc", "sarl", "ltee", "the", "and", "de", "la", "le", "mr", "mrs", "ms"]
UNUSUAL_METHODS = ["gift_card", "voucher", "crypto", "money_transfer_service"]
#: Reports of one sender that make a signal.
MIN_REPORTS = 3
# End of the fixed values.


@dataclass(frozen=True)
class Institution:
    """One entry of a registry: the order decides ties; patterns find its name in a text."""

    ord: int
    name: str
    official: list[str]
    tokens: list[str] = field(default_factory=list)
    patterns: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)


def registry_frames(spark: SparkSession, registry: list[Institution]) -> tuple[DataFrame, DataFrame]:
    """The registry for joins: (ord, official (the first domain), tokens) and (ord, domain), all official domains."""
    first = spark.createDataFrame([(i.ord, i.official[0], i.tokens) for i in registry], "ord int, official string, tokens array<string>")
    return first, spark.createDataFrame([(i.ord, d) for i in registry for d in i.official], "ord int, domain string")


def _found(text: Column, patterns: list[str]) -> Column:
    """Position of the first match of any pattern, from 1; null if none matches."""
    spots = F.array(*[F.nullif(F.regexp_instr(text, F.lit("(?iU)" + p)), F.lit(0)) for p in patterns])
    return F.array_min(spots) if patterns else F.lit(None).cast("int")


def claimed(text: Column, registry: list[Institution]) -> Column:
    """``ord`` of the institution that the text names first; ties go to the registry's order; null if it names none."""
    hits = F.array(*[F.when(_found(text, i.patterns).isNotNull(), F.struct(_found(text, i.patterns).alias("at"), F.lit(i.ord).alias("ord"))) for i in registry])
    return F.array_min(F.array_compact(hits))["ord"]


def claim(text: Column, payment_claim: Column, from_name: Column, registry: list[Institution]) -> Column:
    """The claim of the text, else of the payment's stated organisation, else of the sender's name."""
    return F.coalesce(*[claimed(c, registry) for c in (text, payment_claim, from_name)])


def refers_to(text: Column, ord_: Column, registry: list[Institution]) -> Column:
    """Whether a text names the institution ``ord_`` by a pattern or one of its names."""
    out = F.lit(False)
    for i in registry:
        named = _found(text, i.patterns).isNotNull()
        for n in i.names:
            named = named | F.contains(F.lower(text), F.lit(n.lower()))
        out = F.when(ord_ == i.ord, F.coalesce(named, F.lit(False))).otherwise(out)
    return out


def _group(text: Column, pattern: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, pattern, 1)), F.lit(""))


def observed_sender(text: Column) -> Column:
    """The sender that a message itself shows: a labelled line, else the number to send money or replies to; null if neither."""
    line = F.nullif(F.regexp_replace(_group(text, SENDER_LINE), r"[.,;]+$", ""), F.lit(""))
    return F.coalesce(line, _group(text, SEND_TO), _group(text, REPLY_ON))


def beneficiary(text: Column) -> Column:
    return F.coalesce(*[_group(text, p) for p in BENEFICIARY])


def name_tokens(name: Column) -> Column:
    """Distinct tokens of a party's name, without legal forms and titles."""
    return F.filter(F.array_distinct(F.split(t.stripped(name), "[^a-z0-9]+")), lambda x: (F.length(x) >= 2) & ~x.isin(NAME_STOPWORDS))


def names_match(a: Column, b: Column, registry: list[Institution]) -> Column:
    """Whether two names may be one party: the same institution if both name one, else a shared token; true where nothing can be compared."""
    x, y = claimed(a, registry), claimed(b, registry)
    p, q = name_tokens(a), name_tokens(b)
    return F.when(x.isNotNull() & y.isNotNull(), x == y).when((F.size(p) == 0) | (F.size(q) == 0), True).otherwise(F.arrays_overlap(p, q))


def contradictions(messages: DataFrame, links: DataFrame, registry: list[Institution]) -> DataFrame:
    """ID-01 and ID-02: msg_id, place, code, host, evidence.

    ``messages`` has msg_id, text and ``claim``, an institution's ord or
    null. ID-01: the first link that isn't on one of its official domains,
    shorteners aside; ID-02: a stated beneficiary that isn't the institution.
    """
    spark = messages.sparkSession
    _, official = registry_frames(spark, registry)
    said = messages.where("claim IS NOT NULL").select("msg_id", "claim", "text")
    hosts = links.select("host").distinct().withColumn("domain", F.explode(h.host_suffixes(F.col("host"))))
    owned = hosts.join(F.broadcast(official), "domain").groupBy("host").agg(F.collect_set("ord").alias("owners"))
    pairs = links.where(~F.col("host").isin(h.SHORTENERS)).join(said.select("msg_id", "claim").hint("merge"), "msg_id").join(owned.hint("merge"), "host", "left")
    off = pairs.where(~F.coalesce(F.array_contains("owners", F.col("claim")), F.lit(False)))
    one = off.groupBy("msg_id").agg(F.min_by(F.struct("host", "url"), "ord").alias("x")).select("msg_id", F.lit(0).alias("place"), F.lit("ID-01").alias("code"), "x.host", F.col("x.url").alias("evidence"))
    paid = said.withColumn("to", beneficiary(F.col("text"))).where(F.col("to").isNotNull() & ~refers_to(F.col("to"), F.col("claim"), registry))
    return one.unionAll(paid.select("msg_id", F.lit(1), F.lit("ID-02"), F.lit(None).cast("string"), "to"))


def payment_signals(payments: DataFrame, registry: list[Institution]) -> DataFrame:
    """PAY-02, PAY-05, PAY-06 of what a user says about a payment (msg_id, method, recipient, organisation, on_call): msg_id, place, code, evidence."""
    other = F.col("recipient").isNotNull() & F.col("organisation").isNotNull() & ~names_match(F.col("recipient"), F.col("organisation"), registry)
    hit = lambda place, code, when, evidence: F.when(when, F.struct(F.lit(place).alias("place"), F.lit(code).alias("code"), evidence.alias("evidence")))
    rows = F.array_compact(F.array(
        hit(0, "PAY-02", F.col("method").isin(UNUSUAL_METHODS), F.concat(F.lit("payment method: "), "method")),
        hit(1, "PAY-05", other, F.concat(F.lit('recipient "'), "recipient", F.lit('" vs claimed "'), "organisation", F.lit('"'))),
        hit(2, "PAY-06", F.coalesce(F.col("on_call"), F.lit(False)), F.lit("on a call while paying: yes")),
    ))
    return payments.select("msg_id", F.inline(rows))


def reported_senders(senders: DataFrame, reports: DataFrame) -> DataFrame:
    """REP-03: msg_id, evidence, reports of messages (msg_id, sender) whose sender has MIN_REPORTS reports or more (reports: sender, one row each).

    Both sides meet by the sender's key; reports are counted before the join,
    so a sender with very many costs one row.
    """
    counts = reports.select(t.sender_key(F.col("sender")).alias("key")).where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("reports")).where(F.col("reports") >= MIN_REPORTS)
    return senders.select("msg_id", F.col("sender").alias("evidence"), t.sender_key(F.col("sender")).alias("key")).join(counts.hint("merge"), "key").select("msg_id", "evidence", "reports")
