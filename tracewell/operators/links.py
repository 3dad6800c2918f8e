"""Links of messages and what they imitate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.functions import hosts as h
from tracewell.operators import domains, edits
from tracewell.sources.scratch import dealt, written

#: A link with a scheme, or a bare domain that nothing precedes which would make it part of a word or address.
_SCHEME, _BARE = r"https?://[^\s<>\"'()]+", r"(?:www\.)?(?:[a-z0-9-]+\.)+[a-z]{2,10}(?:/[^\s<>\"'()]*)?"
LINK = f"{_SCHEME}|{_BARE}"
#: An address outside a link is taken whole, so that its domain isn't a link.
_ADDRESS = r"[a-z0-9._%+-]+@[a-z0-9.-]+"


def extract_links(messages: DataFrame) -> DataFrame:
    """msg_id, ord, url, host, path, has_scheme, user_info for every link, in text order; trailing punctuation is cut; unparsable ones and addresses go."""
    found = F.regexp_extract_all(F.lower("text"), F.lit(f"{_SCHEME}|{_ADDRESS}|{_BARE}"), F.lit(0))
    got = messages.select("msg_id", F.posexplode(F.filter(found, lambda x: F.rlike(x, F.lit("^https?://")) | ~F.contains(x, F.lit("@")))).alias("ord", "raw"))
    got = got.withColumn("url", F.regexp_replace("raw", r"[.,;:!?]+$", "")).withColumn("has_scheme", F.rlike("url", F.lit("^https?://")))
    full = F.when(F.col("has_scheme"), F.col("url")).otherwise(F.concat(F.lit("https://"), "url"))
    got = got.withColumn("full", full).withColumn("host", h.normal_host(F.try_parse_url("full", F.lit("HOST"))))
    got = got.where("host IS NOT NULL AND host <> ''")
    return got.select("msg_id", F.col("ord").cast("long").alias("ord"), "url", "host", F.coalesce(F.try_parse_url("full", F.lit("PATH")), F.lit("")).alias("path"), "has_scheme", F.try_parse_url("full", F.lit("USERINFO")).alias("user_info"))


def registry_frame(spark: SparkSession, rows: list[tuple[int, str, str, list[str]]]) -> DataFrame:
    """(ord, name, official domain, brand tokens) as a relation; a registry is a small dimension."""
    return spark.createDataFrame(rows, "ord int, name string, official string, tokens array<string>")


def typos(labels: DataFrame, official: DataFrame) -> DataFrame:
    """Labels within the allowed edits of an official one, by a deletion neighbourhood: label, official_label. Both tables have ``label``."""
    ours = dealt(written(labels.select("label").distinct(), "labels"), domains.HOSTS_A_TASK, "label").withColumn("key", F.explode(edits.all_keys(F.col("label"), h.EDIT_LENGTHS)))
    theirs = official.select(F.col("label").alias("official_label")).distinct().withColumn("key", F.explode(edits.keys(F.col("official_label"), h.max_edits(F.length("official_label")), 2)))
    pairs = written(ours.join(F.broadcast(theirs), "key").select("label", "official_label").distinct(), "typos")
    return pairs.where(F.levenshtein("label", "official_label") <= h.max_edits(F.length("official_label")))


def imitations(links: DataFrame, registry: DataFrame, brands: DataFrame | None = None, trusted: DataFrame | None = None) -> DataFrame:
    """Links that imitate a registered domain: msg_id, ord, host, code, official.

    URL-02: a brand token is a hyphen part of the registrable label; URL-01:
    the label is within the allowed edits of an official one, or looks the
    same; then imitations of global ``brands`` (ord, domain), by the same
    codes; URL-03: a token is a part of a subdomain or a segment of the path,
    not on ``trusted`` hosts (column host). The first of these wins, then the
    registry's order. Official hosts and shorteners imitate nothing. Work is
    per distinct host and path, and every join is one of equal keys.
    """
    spots = links.select("host", "path").distinct()
    reg = registry.select(F.col("ord").alias("reg_ord"), "official", "tokens", h.registrable_label(F.col("official")).alias("label"))
    # Registries are broadcast; what grows with the links never is.
    reg, known = F.broadcast(reg), F.broadcast(registry.select(F.col("official").alias("suffix")))
    parents = spots.select("host", F.explode(h.host_suffixes(F.col("host"))).alias("suffix")).join(known, "suffix").select("host").distinct()
    spots = spots.join(parents.hint("merge"), "host", "left_anti").where(~F.col("host").isin(h.SHORTENERS))
    # Seven branches read this.
    spots = written(spots.withColumn("label", h.registrable_label(F.col("host"))).withColumn("subs", h.subdomains(F.col("host"))), "spots")
    tokens = F.broadcast(registry.select(F.col("ord").alias("reg_ord"), "official", F.explode("tokens").alias("part")))
    hit = lambda df, rank, code: df.select("host", "path", F.lit(rank).alias("rank"), "reg_ord", F.lit(code).alias("code"), "official")
    in_label = hit(spots.select("host", "path", F.explode(F.split("label", "-")).alias("part")).join(tokens, "part"), 1, "URL-02")
    near = hit(spots.join(typos(spots, reg).hint("merge"), "label").join(reg.select("reg_ord", "official", F.col("label").alias("official_label")), "official_label"), 2, "URL-01")
    folded = spots.withColumn("fold", h.visual_fold(F.col("label"))).join(reg.select("reg_ord", "official", F.col("label").alias("official_label"), h.visual_fold(F.col("label")).alias("fold")), "fold")
    folded = hit(folded.where("label <> official_label"), 2, "URL-01")
    around = F.array_distinct(F.concat(F.flatten(F.transform("subs", lambda s: F.split(s, "-"))), F.split(F.lower("path"), r"[/\-_.?=&]+")))
    named = spots if trusted is None else spots.join(trusted.select("host").distinct().hint("merge"), "host", "left_anti")
    elsewhere = hit(named.select("host", "path", F.explode(around).alias("part")).where("part <> ''").join(tokens, "part"), 4, "URL-03")
    found = in_label.unionAll(near).unionAll(folded).unionAll(elsewhere)
    if brands is not None:
        none = spots.select("host").where("false")
        copies = written(domains.brand_imitations(spots.select("host"), brands, none if trusted is None else trusted), "brands")
        found = found.unionAll(spots.select("host", "path").join(copies.hint("merge"), "host").select("host", "path", F.lit(3), F.lit(0), "code", "official"))
    first = Window.partitionBy("host", "path").orderBy("rank", "reg_ord")
    best = found.withColumn("turn", F.row_number().over(first)).where("turn = 1").select("host", "path", "code", "official")
    return links.join(best.hint("merge"), ["host", "path"]).select("msg_id", "ord", "host", "code", "official")


#: A call to act: verify, log in, update, claim or pay. Fixed value.
CALL = r"(?iU)\b(?:verify|confirm|log ?in|sign ?in|update|unlock|reactivate|restore|claim|click|tap|v[ée]rifiez|confirmez|connectez|cliquez|mettez à jour|verifye|konfirm|klik)\b"


def unofficial_calls(messages: DataFrame, links: DataFrame, official: DataFrame, trusted: DataFrame) -> DataFrame:
    """URL-08: a message calls to act and has a link that is neither official, nor trusted, nor on the site it was found on: msg_id, host (the first such link's), evidence.

    ``official`` has domain, ``trusted`` host; ``messages`` may have
    page_host, the host of the page that the text was read from.
    """
    out = links.join(domains.below(links, official).select("host"), "host", "left_anti").join(trusted.select("host").distinct().hint("merge"), "host", "left_anti")
    calls = messages.where(F.rlike("text", F.lit(CALL))).select("msg_id", F.regexp_extract("text", CALL, 0).alias("evidence"), *(["page_host"] if "page_host" in messages.columns else []))
    both = out.join(calls.hint("merge"), "msg_id")
    if "page_host" in messages.columns:
        both = both.where(~h.same_site(F.col("host"), F.col("page_host")))
    return both.groupBy("msg_id").agg(F.min_by("host", "ord").alias("host"), F.first("evidence").alias("evidence"))


def hygiene(links: DataFrame) -> DataFrame:
    """Shortened links (URL-05), raw addresses (URL-06), disguised hosts (URL-07): msg_id, ord, host, code."""
    octets = F.forall(F.split("host", r"\."), lambda o: F.coalesce(F.try_to_number(o, F.lit("999")), F.lit(999)) <= 255)
    raw_ip = F.rlike("host", F.lit(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")) & octets & (F.col("has_scheme") | (F.col("path") != ""))
    codes = F.array_compact(F.array(F.when(F.col("host").isin(h.SHORTENERS), "URL-05"), F.when(raw_ip, "URL-06"), F.when(F.col("user_info").isNotNull(), "URL-07")))
    return links.select("msg_id", "ord", "host", F.explode(codes).alias("code"))


def threat_hits(links: DataFrame, listed: DataFrame, shared: DataFrame | None = None, official: DataFrame | None = None) -> DataFrame:
    """Links on a threat list of (host, path): the host equal, and the path equal to or below the listed one (an empty one: any).

    With ``shared`` (column host) a listed path matters on these hosts only,
    where many owners publish; of any other listed host every link is a hit.
    Links of ``official`` domains (column domain) are never hits.
    """
    on = listed.select(F.col("host").alias("l_host"), F.col("path").alias("l_path"))
    below = (F.col("l_path") == "") | (F.col("path") == F.col("l_path")) | F.startswith("path", F.concat("l_path", F.lit("/")))
    if shared is not None:
        many = shared.select(F.col("host").alias("l_host"), F.lit(True).alias("many")).distinct()
        on = on.join(many, "l_host", "left").withColumn("many", F.coalesce("many", F.lit(False)))
        on = on.where("NOT many OR l_path NOT IN ('', '/')").select("l_host", F.when(F.col("many"), F.col("l_path")).otherwise("").alias("l_path")).distinct()
    if official is not None:
        links = links.join(domains.below(links, official).select("host"), "host", "left_anti")
    return links.join(on.hint("merge"), F.col("host") == F.col("l_host")).where(below).select("msg_id", "ord", "host", F.col("l_path").alias("listed_path"))


def slug(text: Column) -> Column:
    """Lower-case letters and digits with single hyphens; 'unknown' if nothing is left."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    out = F.btrim(F.regexp_replace(plain, "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(out == "", "unknown").otherwise(out)
