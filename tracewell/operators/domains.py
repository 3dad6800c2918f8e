"""How hosts imitate trusted domains, by equal keys and without comparing every pair."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import hosts as h
from tracewell.operators import edits
from tracewell.operators.offsets import computed
from tracewell.sources.scratch import dealt, written

#: Relations of a host to a trusted domain, the first that holds counts. Fixed values.
RELATIONS = ["same", "sibling", "homoglyph", "label_split", "subdomain_abuse", "tld_swap", "confusable", "typo", "brand_embedded"]
#: The shortest brand that counts for typos and inside longer labels.
LEAST_BRAND = 5
# End of the fixed values.
#: Hosts whose keys one task makes, and trusted hosts whose keys may be broadcast: one has some 20 KB of them.
HOSTS_A_TASK, MOST_BROADCAST = 2_000, 1_000

_FORMS = "host string, unicode string, compat string, plain string"


def decoded_label(label: str) -> str:
    """A label whose xn-- form is decoded; one that can't be stays as it is."""
    if not label.startswith("xn--"):
        return label
    try:
        return label[4:].encode("ascii").decode("punycode").lower()
    except (UnicodeError, ValueError):
        return label


def forms(host: str) -> tuple[str, str, str]:
    """The decoded host, its compatibility form, and the host without combining marks."""
    text = ".".join(decoded_label(x) for x in host.split("."))
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return text, unicodedata.normalize("NFKC", text).lower(), plain


def _forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(x, *forms(x)) for x in b["host"]]
        yield pd.DataFrame(rows, columns=["host", "unicode", "compat", "plain"])


def host_forms(hosts: DataFrame) -> DataFrame:
    """Distinct ``host`` values with unicode (xn-- labels decoded), compat (NFKC) and plain (NFKD without marks).

    Only hosts that are encoded or not ASCII leave the JVM, in Arrow batches.
    Both kinds read the hosts from a table, so what makes them runs once.
    """
    d = computed(hosts.select("host").distinct(), normal=h.normal_host(F.col("host")))
    d = written(d.select(F.col("normal").alias("host")).where("host IS NOT NULL AND host <> ''").distinct(), "plain-hosts")
    odd = F.rlike("host", F.lit(r"[^\x00-\x7f]|(^|\.)xn--"))
    usual = d.where(~odd).select("host", F.col("host").alias("unicode"), F.col("host").alias("compat"), F.col("host").alias("plain"))
    return usual.unionAll(d.where(odd).mapInPandas(_forms, _FORMS))


def _keyed(kind: str, keys: Column) -> Column:
    """An array of keys as (kind, key) pairs."""
    return F.transform(keys, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))


def _one(kind: str, key: Column, when: Column | None = None) -> Column:
    keys = F.array(key)
    return _keyed(kind, keys if when is None else F.when(when, keys).otherwise(F.array().cast("array<string>")))


def substrings(text: Column, least: int) -> Column:
    """All different substrings of at least ``least`` characters; a host's label has at most 63."""
    n = F.length(text)
    starts = lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substr(text, i, k))
    return F.when(n >= least, F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(least), n), starts)))).otherwise(F.array().cast("array<string>"))


def _candidate_keys(hosts: DataFrame) -> DataFrame:
    a = F.col("unicode")
    c = computed(hosts, label=h.registrable_label(a), registrable=h.registrable_domain(a), subs=h.subdomains(a))
    joined = F.array_join(F.concat("subs", F.array("label")), "")
    odd = F.rlike(a, F.lit(r"[^\x00-\x7f]"))
    keys = F.flatten(F.array(
        _keyed("same", h.host_suffixes(a)),
        _one("sibling", F.col("registrable")),
        _one("homoglyph", F.concat(F.lit("="), h.registrable_label(h.skeleton(F.col("compat")))), odd),
        _one("homoglyph", F.concat(F.lit("~"), h.visual_fold(h.registrable_label(F.col("plain")))), odd),
        _one("label_split", F.concat(F.lit("="), joined), F.size("subs") >= 1),
        _one("label_split", F.concat(F.lit("-"), F.replace("label", F.lit("-"), F.lit("")))),
        _keyed("subdomain_abuse", F.array_distinct("subs")),
        _one("tld_swap", F.col("label")),
        _one("confusable", h.visual_fold(h.skeleton(F.col("label")))),
        _keyed("typo", edits.all_keys(F.col("label"), {1: h.EDIT_LENGTHS[1], 2: h.EDIT_LENGTHS[2]})),
        _keyed("brand_embedded", substrings(F.col("label"), LEAST_BRAND)),
    ))
    return c.select("host", "label", F.explode(F.array_distinct(keys)).alias("k")).select("host", "label", "k.*")


def _trusted_keys(trusted: DataFrame) -> DataFrame:
    t = computed(trusted, brand=h.registrable_label(F.col("unicode")))
    brand, long = F.col("brand"), F.length("brand") >= LEAST_BRAND
    fold = h.visual_fold(brand)
    keys = F.flatten(F.array(
        _one("same", F.col("unicode")),
        _one("sibling", h.registrable_domain(F.col("unicode"))),
        _one("homoglyph", F.concat(F.lit("="), brand)),
        _one("homoglyph", F.concat(F.lit("~"), fold)),
        _one("label_split", F.concat(F.lit("="), brand)),
        _one("label_split", F.concat(F.lit("-"), F.replace(brand, F.lit("-"), F.lit("")))),
        _one("subdomain_abuse", brand),
        _one("tld_swap", brand),
        _one("confusable", fold),
        _keyed("typo", F.when(long, edits.keys(brand, h.max_edits(F.length(brand)), 2)).otherwise(F.array().cast("array<string>"))),
        _one("brand_embedded", brand, long),
    ))
    return t.select("trusted", "brand", F.explode(F.array_distinct(keys)).alias("k")).select("trusted", "brand", "k.*")


def relations(hosts: DataFrame, trusted: DataFrame) -> DataFrame:
    """host, trusted, relation for every host and trusted domain that have one.

    ``hosts`` has ``host``, ``trusted`` has ``domain``. Both sides emit (kind,
    key) rows and meet in one join of equal keys; typos are then measured.
    Of several relations the first of RELATIONS counts. A label of n
    characters emits about n*n/2 keys, and labels end at 63. Spark knows
    nothing of how many keys a host makes, so hosts are dealt to tasks by
    their number, and the keys of many trusted hosts are never broadcast.
    """
    known = written(host_forms(trusted.select(F.col("domain").alias("host"))).withColumnRenamed("host", "trusted"), "trusted")
    keys = _trusted_keys(dealt(known, HOSTS_A_TASK, "trusted"))
    keys = keys.hint("merge") if known.count() > MOST_BROADCAST else keys
    pairs = _candidate_keys(dealt(written(host_forms(hosts), "hosts"), HOSTS_A_TASK, "host")).join(keys, ["kind", "key"])
    far = (F.col("kind") == "typo") & (F.levenshtein("label", "brand") > h.max_edits(F.length("brand")))
    unsplit = (F.col("kind") == "label_split") & F.startswith("key", F.lit("-")) & (F.col("label") == F.col("brand"))
    rank = F.array_position(F.array(*[F.lit(x) for x in RELATIONS]), F.col("kind"))
    best = pairs.where(~far & ~unsplit).groupBy("host", "trusted").agg(F.min(rank).alias("rank"))
    return best.select("host", "trusted", F.element_at(F.array(*[F.lit(x) for x in RELATIONS]), F.col("rank").cast("int")).alias("relation"))


def compared(relation: Column) -> Column:
    """same, sibling, lookalike or different, of a relation or null; an embedded brand alone is no look-alike."""
    return F.when(relation.isin("same", "sibling"), relation).when(relation.isNull() | (relation == "brand_embedded"), "different").otherwise("lookalike")


def below(hosts: DataFrame, domains: DataFrame) -> DataFrame:
    """Distinct hosts that are one of ``domains`` (column domain) or below one, joined by equal suffixes: host, domain (the longest).

    ``domains`` is a registry and broadcast: of a list in memory Spark knows
    no size and would broadcast the hosts instead. The result grows with the
    hosts, so what joins it doesn't broadcast it.
    """
    d = F.broadcast(domains.select(h.normal_host(F.col("domain")).alias("suffix")).distinct())
    return hosts.select("host").distinct().withColumn("suffix", F.explode(h.host_suffixes(F.col("host")))).join(d, "suffix").groupBy("host").agg(F.max_by("suffix", F.length("suffix")).alias("domain")).hint("merge")


def trusted_hosts(hosts: DataFrame, trusted: DataFrame, user_content: DataFrame) -> DataFrame:
    """Hosts of a trusted domain, without those where anyone may publish: host, domain."""
    return below(hosts, trusted).join(below(hosts, user_content).select("host"), "host", "left_anti")


def shared_hosts(hosts: DataFrame, trusted: DataFrame, user_content: DataFrame, shared: DataFrame) -> DataFrame:
    """Hosts that many owners share: trusted ones, those where anyone may publish, and hosting platforms: host."""
    all_ = trusted.select("domain").unionAll(user_content.select("domain")).unionAll(shared.select("domain"))
    return below(hosts, all_).select("host")


def brand_imitations(hosts: DataFrame, brands: DataFrame, exempt: DataFrame) -> DataFrame:
    """Hosts that imitate a global brand: host, code, official.

    ``brands`` has ord and domain; ``exempt`` is hosts that are never
    reported. URL-02: a hyphen part looks like the brand; URL-01: the label
    does, or is a typo of it with the same first letter. A label that is the
    brand itself, under any suffix, imitates nothing of that brand. The first
    brand in order counts.
    """
    d = hosts.select(h.normal_host(F.col("host")).alias("host")).distinct()
    d = d.join(below(d, brands).select("host"), "host", "left_anti").join(exempt.select("host").distinct().hint("merge"), "host", "left_anti")
    d = dealt(written(computed(d, label=h.registrable_label(F.col("host"))), "brand-hosts"), HOSTS_A_TASK, "host")
    parts = F.split("label", "-")
    keys = F.flatten(F.array(
        _keyed("part", F.when(F.size(parts) > 1, F.transform(parts, h.visual_fold)).otherwise(F.array().cast("array<string>"))),
        _one("fold", h.visual_fold(F.col("label"))),
        _keyed("typo", edits.all_keys(F.col("label"), h.EDIT_LENGTHS)),
    ))
    c = d.select("host", "label", F.explode(F.array_distinct(keys)).alias("k")).select("host", "label", "k.*")
    b = brands.select("ord", F.col("domain").alias("official"), h.registrable_label(F.col("domain")).alias("brand"))
    fold = h.visual_fold(F.col("brand"))
    b_keys = F.flatten(F.array(_one("part", fold), _one("fold", fold), _keyed("typo", edits.keys(F.col("brand"), h.max_edits(F.length("brand")), 2))))
    b = b.select("ord", "official", "brand", F.explode(b_keys).alias("k")).select("ord", "official", "brand", "k.*")
    hit = c.join(F.broadcast(b), ["kind", "key"]).where("label <> brand")
    near = (F.levenshtein("label", "brand") <= h.max_edits(F.length("brand"))) & (F.left("label", F.lit(1)) == F.left("brand", F.lit(1)))
    hit = hit.where((F.col("kind") != "typo") | near).withColumn("code", F.when(F.col("kind") == "part", "URL-02").otherwise("URL-01"))
    first = hit.groupBy("host").agg(F.min_by(F.struct("code", "official"), F.struct("ord", F.when(F.col("code") == "URL-02", 0).otherwise(1))).alias("x"))
    return first.select("host", "x.*")


#: Hosts of any script in running text, with an optional scheme and path. Fixed value.
UNICODE_HOST = r"(?iu)(?:https?://)?((?:[\p{L}\p{N}-]+\.)+\p{L}{2,10})(?:/[^\s<>\"'()]*)?"


def homoglyphs(messages: DataFrame, registry: DataFrame, brands: DataFrame) -> DataFrame:
    """URL-04, hosts in look-alike letters or encoded ones: msg_id, place, code, host, evidence, skeleton, official.

    ``official`` is the registered domain that the skeleton belongs to, else
    the one whose token is a part of a label, else a global brand's; it may
    be null, the host is reported all the same. ``registry`` has ord,
    official, tokens.
    """
    odd = r"[^\x00-\x7f]|(?i:(^|[./])xn--)"
    found = messages.where(F.rlike("text", F.lit(odd))).select("msg_id", F.posexplode(F.regexp_extract_all("text", F.lit(UNICODE_HOST), F.lit(0))).alias("place", "evidence"))
    found = found.withColumn("host", F.lower(F.regexp_extract("evidence", UNICODE_HOST, 1))).where(F.rlike("host", F.lit(r"[^\x00-\x7f]|(^|\.)xn--")))
    distinct = found.select("host").distinct()
    skel = host_forms(distinct).select("host", h.skeleton(F.when(F.rlike("host", F.lit(r"[^\x00-\x7f]")), F.col("compat")).otherwise(F.col("host"))).alias("skeleton"))
    # host_forms drops a leading www., so the raw host finds its row by the same rule.
    spots = skel.select(F.col("skeleton").alias("host")).distinct()
    owned = below(spots, registry.select(F.col("official").alias("domain"))).select("host", F.lit(0).alias("rank"), F.lit(0).alias("ord"), F.col("domain").alias("official"))
    tokens = registry.select("ord", "official", F.explode("tokens").alias("part"))
    parts = spots.select("host", F.explode(F.flatten(F.transform(F.split("host", r"\."), lambda x: F.split(x, "-")))).alias("part"))
    named = parts.join(F.broadcast(tokens), "part").select("host", F.lit(1).alias("rank"), "ord", "official")
    branded = below(spots, brands).select("host", F.lit(2).alias("rank"), F.lit(0).alias("ord"), F.col("domain").alias("official"))
    target = owned.unionAll(named).unionAll(branded).groupBy(F.col("host").alias("skeleton")).agg(F.min_by("official", F.struct("rank", "ord")).alias("official"))
    out = found.withColumn("plain_host", h.normal_host(F.col("host"))).join(skel.withColumnRenamed("host", "plain_host").hint("merge"), "plain_host").join(target.hint("merge"), "skeleton", "left")
    return out.select("msg_id", F.col("place").cast("long").alias("place"), F.lit("URL-04").alias("code"), "host", "evidence", "skeleton", "official")

