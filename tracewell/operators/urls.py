"""Whole verdicts on links: what they imitate, how old their domain is, what their certificate says, who reported them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import hosts as h
from tracewell.operators import domains, links
from tracewell.operators.identity import Institution, registry_frames
from tracewell.sources.scratch import written

# Results depend on them.
NEW_DOMAIN_DAYS, VERY_NEW_DAYS = 30, 7
NEW_CERTIFICATE_DAYS = 7
MIN_REPORTS = 3
#: Tunnels and dynamic names: public addresses for any computer.
TUNNELS = [
    "ngrok.io", "ngrok-free.app", "ngrok.app", "ngrok-free.dev", "trycloudflare.com", "loca.lt", "localtunnel.me", "serveo.net", "localhost.run", "lhr.life", "pinggy.link",
    "duckdns.org", "ddns.net", "hopto.org", "zapto.org", "no-ip.org", "no-ip.biz", "sytes.net", "freeddns.org", "dynu.net", "000webhostapp.com",
]
#: A server that leaves out its intermediate certificate isn't untrusted.
INCOMPLETE_CHAIN = ["UNABLE_TO_VERIFY_LEAF_SIGNATURE", "UNABLE_TO_GET_ISSUER_CERT_LOCALLY", "UNABLE_TO_GET_ISSUER_CERT"]
LOOKALIKE = ["URL-01", "URL-02", "URL-03", "URL-04"]
# End of the fixed values.


def dated_domain(host: Column) -> Column:
    """The registrable domain whose age can be looked up; null for addresses and single labels."""
    return F.when(F.rlike(host, F.lit(r"^\d{1,3}(?:\.\d{1,3}){3}$")) | F.contains(host, F.lit(":")) | ~F.contains(host, F.lit(".")), None).otherwise(h.registrable_domain(host))


def age_signal(days: Column, certificate_days: Column) -> Column:
    """Severity of URL-09, or null: by days since registration, else, never high, since the first certificate."""
    old = days >= NEW_DOMAIN_DAYS
    return F.when(days.isNotNull(), F.when(old, None).when(days < VERY_NEW_DAYS, "high").otherwise("medium")).when(certificate_days < NEW_DOMAIN_DAYS, "medium")


def certificate_problem(valid_from: Column, valid_to: Column, self_signed: Column, covers_host: Column, authorized: Column, error: Column, now: Column) -> Column:
    """expired, not_yet_valid, self_signed, wrong_host, untrusted or null, the first that applies."""
    return (
        F.when(valid_to < now, "expired").when(valid_from > now, "not_yet_valid").when(self_signed, "self_signed").when(~covers_host, "wrong_host")
        .when(~F.coalesce(authorized, F.lit(False)) & ~F.coalesce(error.isin(INCOMPLETE_CHAIN), F.lit(False)), "untrusted")
    )


def certificate_kind(policies: Column, organisation: Column, extended: list[str]) -> Column:
    """EV, OV or DV: by a policy of the extended ones, else by a named organisation."""
    return F.when(F.arrays_overlap(policies, F.array(*[F.lit(x) for x in extended])), "EV").when(F.coalesce(organisation, F.lit("")) != "", "OV").otherwise("DV")


def form_signals(forms: DataFrame, registry: list[Institution], trusted: DataFrame) -> DataFrame:
    """URL-10, pages that show an institution and send passwords or card numbers elsewhere: page_id, code, host, fields.

    ``forms`` has page_id, page_host, claim (an institution's ord), action_host
    (null: the page itself), has_password, has_card; one row a form.
    """
    _, official = registry_frames(forms.sparkSession, registry)
    f = forms.where("claim IS NOT NULL AND page_host IS NOT NULL AND (has_password OR has_card)").withColumn("host", h.normal_host(F.coalesce("action_host", "page_host")))
    seen = f.select("host").unionAll(f.select(h.normal_host(F.col("page_host")))).distinct().withColumn("domain", F.explode(h.host_suffixes(F.col("host"))))
    owned = written(seen.join(official, "domain").select("host", "ord").distinct(), "owned")
    for column in ("page_host", "host"):
        f = f.join(owned.select(F.col("host").alias("_h"), F.col("ord").alias("_o")), (h.normal_host(F.col(column)) == F.col("_h")) & (F.col("claim") == F.col("_o")), "left_anti")
    f = f.where(~h.same_site(F.col("host"), F.col("page_host"))).join(trusted.select("host").distinct(), "host", "left_anti")
    kinds = F.array_sort(F.flatten(F.collect_set(F.array_compact(F.array(F.when(F.col("has_card"), "card"), F.when(F.col("has_password"), "password"))))))
    return f.groupBy("page_id", "host").agg(F.array_join(F.array_distinct(kinds), ",").alias("fields")).select("page_id", F.lit("URL-10").alias("code"), "host", "fields")


def assess(urls: DataFrame, registry: list[Institution], brands: DataFrame, trusted: DataFrame, listed: DataFrame, shared: DataFrame, ages: DataFrame, certificates: DataFrame, reports: DataFrame) -> DataFrame:
    """Signals of links: url_id, code, severity, host.

    ``urls`` has url_id and url. ``trusted`` lists hosts, ``listed`` and
    ``shared`` are as threat_hits reads them. ``ages`` has domain, days (since
    registration) and certificate_days (since the first certificate), either
    may be null; ``certificates`` has host, problem (null: valid) and
    issued_days, and is asked for https links only; ``reports`` has host, one
    row a report. Age and reports never count for official and trusted hosts.
    What is missing from a table makes no signal. All are joined by equal
    keys on distinct hosts.
    """
    m = urls.select(F.col("url_id").alias("msg_id"), F.col("url").alias("text"))
    found = written(links.extract_links(m), "url-links")
    first, official = registry_frames(urls.sparkSession, registry)
    row = lambda df, severity=None: df.select(F.col("msg_id").alias("url_id"), "code", (F.lit(None).cast("string") if severity is None else severity).alias("severity"), "host")
    static = row(links.imitations(found, first, brands, trusted)).unionAll(row(domains.homoglyphs(m, first, brands))).unionAll(row(links.hygiene(found)))
    hits = links.threat_hits(found, listed, shared, official.select("domain")).select("msg_id", F.lit("REP-05").alias("code"), "host").distinct()
    static = written(static.unionAll(row(hits)), "url-static")
    hosts = written(found.where("ord = 0").select(F.col("msg_id").alias("url_id"), "host", F.startswith("url", F.lit("https:")).alias("secure")), "url-hosts")
    distinct = hosts.select("host").distinct()
    tunnels = domains.below(distinct, urls.sparkSession.createDataFrame([(x,) for x in TUNNELS], "domain string")).select("host", F.lit("URL-11").alias("code"), F.lit("medium").alias("severity"))
    open_ = distinct.join(domains.below(distinct, official.select("domain")).select("host"), "host", "left_anti").join(trusted.select("host").distinct(), "host", "left_anti")
    reported = reports.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_REPORTS).join(open_, "host", "left_semi").select("host", F.lit("REP-03").alias("code"), F.lit("medium").alias("severity"))
    aged = open_.withColumn("domain", dated_domain(F.col("host"))).join(ages, "domain").select("host", F.lit("URL-09").alias("code"), age_signal(F.col("days"), F.col("certificate_days")).alias("severity")).where("severity IS NOT NULL")
    by_host = hosts.select("url_id", "host").join(tunnels.unionAll(reported).unionAll(aged), "host").select("url_id", "code", "severity", "host")
    like = static.where(F.col("code").isin(LOOKALIKE)).select("url_id", F.lit(True).alias("like")).distinct()
    c = hosts.where("secure").join(certificates.select("host", "problem", "issued_days"), "host").join(like, "url_id", "left")
    code = F.when(F.col("problem").isNotNull(), "CERT-01").when(F.col("like") & (F.col("issued_days") < NEW_CERTIFICATE_DAYS), "CERT-02")
    c = c.select("url_id", code.alias("code"), F.when(code == "CERT-01", "high").otherwise("medium").alias("severity"), "host").where("code IS NOT NULL")
    return static.unionAll(by_host).unionAll(c)
