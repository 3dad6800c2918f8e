"""Workplace email: signals EMAIL-01 to EMAIL-10 and ORG-01, ORG-03, ORG-04.

Emails have msg_id, ts (seconds), thread, from_name, from_address, recipient,
subject, text, reply_to (array), spf, dkim, dmarc (all null: not supplied),
attachments (array of name, type), pay_recipient, pay_last4. A check runs only
on evidence that is there: what is null makes no signal. Suppliers are tables
of any size; the organisation's own profile is configuration.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import hosts as h
from tracewell.operators import containment, domains, offsets
from tracewell.operators.identity import Institution, claimed, names_match
from tracewell.sources.scratch import dealt, written

# Results depend on them.
FREEMAIL = ["gmail.com", "googlemail.com", "outlook.com", "hotmail.com", "live.com", "msn.com", "yahoo.com", "yahoo.fr", "ymail.com", "icloud.com", "me.com", "aol.com", "proton.me", "protonmail.com", "gmx.com", "gmx.net", "mail.com", "yandex.com", "zoho.com", "orange.mu"]
RISKY_TYPES = ["html", "htm", "shtml", "xhtml", "svg", "iso", "img", "vhd", "vhdx", "exe", "scr", "com", "pif", "bat", "cmd", "js", "jse", "vbs", "vbe", "wsf", "hta", "lnk", "msi", "ps1", "jar", "cab", "reg"]
DOCUMENT_TYPES = ["pdf", "doc", "docx", "xls", "xlsx", "csv", "txt", "jpg", "jpeg", "png", "zip", "rtf", "odt"]
ACTIVE_CONTENT = r"^(?:text/html|application/(?:x-msdownload|x-msdos-program|javascript|x-javascript|hta|x-iso9660-image|vnd\.ms-htmlhelp)|image/svg\+xml)"
REVERSED = "[\u202e\u202d]"
SENIOR_TITLE = r"(?iU)\b(?:ceo|cfo|coo|md|chief [a-z]+ officer|managing director|finance director|director general|president|chairman|chairperson|directeur(?: g[ée]n[ée]ral| financier)?|pdg|head of finance)\b"
EMBEDDED_ADDRESS = r"(?i)[^\s<>\"'@]+@([a-z0-9.-]+\.[a-z]{2,})"
ACCOUNT_ENDING = r"(?i)\b(?:account|acct|a/c|iban|compte|kont)\b[^.\n]{0,20}?\b(?:ending|ends|se terminant par)\s*(?:in\s+|with\s+|par\s+)?(\d{4})\b"
ACCOUNT_NUMBER = r"(?i)\b(?:account|acct|a/c|iban|compte|kont)\b(?:\s+(?:number|no\.?|num[ée]ro|nimero|#))?\s*[:#-]?\s*((?:[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]){8,30})|\d[\d -]{4,28}\d)"
MASKED_ACCOUNT = r"(?i)(?:\*{2,}|x{3,}|•{2,})\s?(\d{4})\b"
PAYEE = r"(?imU)\b(?:beneficiary(?: name)?|account name|account holder|payee|b[ée]n[ée]ficiaire|titulaire du compte|nom du compte)\s*[:\-]\s*(\p{L}[\p{L} .'&-]{1,60}?)\s*(?:$|\n|,|;|\.\s)"
#: Parts of a label that make a lure of an embedded brand.
LURES = ["login", "logon", "signin", "sso", "auth", "secure", "security", "verify", "verification", "account", "accounts", "portal", "mail", "webmail", "outlook", "office", "o365", "m365", "helpdesk", "support", "it", "hr", "payroll", "pay", "payment", "payments", "finance", "invoice", "billing", "update", "reset", "password", "admin", "service", "desk"]
#: Of several techniques against the organisation's domains and tokens the first counts.
TECHNIQUE_ORDER = ["homoglyph", "label_split", "subdomain_abuse", "confusable", "typo", "tld_swap", "brand_embedded"]
FIRST_CONTACT_SECONDS = 7 * 24 * 3600
# End of the fixed values.
#: Emails that one task reads: their patterns take longer than their bytes tell.
EMAILS_A_TASK = 50_000


@dataclass(frozen=True)
class Organisation:
    """An organisation's profile: people are (name, role, addresses), roles (function, labels, addresses)."""

    name: str
    domains: list[str]
    tokens: list[str] = field(default_factory=list)
    people: list[tuple[str, str, list[str]]] = field(default_factory=list)
    roles: list[tuple[str, list[str], list[str]]] = field(default_factory=list)


def domain_of(address: Column) -> Column:
    """The lower-case domain of an address; null if it has none."""
    return F.nullif(F.regexp_replace(F.regexp_extract(F.lower(F.trim(address)), r"^[^\s@<>(),;:\"\\]+@([^\s@<>(),;:\"\\]+\.[^\s@<>(),;:\"\\]+)$", 1), r"\.$", ""), F.lit(""))


def freemail(domain: Column) -> Column:
    return F.coalesce(h.registrable_domain(domain).isin(FREEMAIL), F.lit(False))


def key(name: Column) -> Column:
    """A name's words with single blanks."""
    return F.array_join(containment.name_words(name), " ")


def account_ends(text: Column) -> Column:
    """Last four digits of the accounts that a text asks to pay into, each once."""
    t = F.coalesce(text, F.lit(""))
    numbers = F.transform(F.regexp_extract_all(t, F.lit(ACCOUNT_NUMBER), F.lit(1)), lambda x: F.regexp_replace(x, r"\D", ""))
    long = F.transform(F.filter(numbers, lambda x: F.length(x) >= 6), lambda x: F.right(x, F.lit(4)))
    return F.array_distinct(F.concat(F.regexp_extract_all(t, F.lit(ACCOUNT_ENDING), F.lit(1)), F.regexp_extract_all(t, F.lit(MASKED_ACCOUNT), F.lit(1)), long))


def payee(text: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), PAYEE, 1)), F.lit(""))


def attachment_risk(name: Column, kind: Column) -> Column:
    """double_extension, type_mismatch, risky_type or null, from name and content type alone."""
    parts = F.transform(F.split(F.lower(name), r"\."), lambda x: F.trim(x))
    n = F.size(parts)
    ext, inner = F.when(n > 1, F.element_at(parts, -1)).otherwise(""), F.when(n > 2, F.element_at(parts, -2)).otherwise("")
    return (
        F.when(F.rlike(name, F.lit(REVERSED)) | (inner.isin(DOCUMENT_TYPES) & ext.isin(RISKY_TYPES)), "double_extension")
        .when(ext.isin(DOCUMENT_TYPES) & F.rlike(F.coalesce(kind, F.lit("")), F.lit(ACTIVE_CONTENT)), "type_mismatch")
        .when(ext.isin(RISKY_TYPES), "risky_type")
    )


def authentication(spf: Column, dkim: Column, dmarc: Column, known: Column) -> Column:
    """What failed, or null. One mechanism that fails while the other passes is what forwarding looks like."""
    spf_failed, dkim_failed = spf.isin("fail", "softfail"), dkim == "fail"
    given = spf.isNotNull() | dkim.isNotNull() | dmarc.isNotNull()
    a, b = F.coalesce(spf_failed, F.lit(False)), F.coalesce(dkim_failed, F.lit(False))
    weak = (a & F.coalesce(dkim != "pass", F.lit(True))) | (b & F.coalesce(spf != "pass", F.lit(True)))
    return F.when(~given | (dmarc == "pass"), None).when((dmarc == "fail") & known, "dmarc_fail_known_domain").when(dmarc == "fail", "dmarc_fail").when(a & b, "spf_and_dkim_fail").when(weak, "partial_fail")


def thread_changes(emails: DataFrame) -> DataFrame:
    """EMAIL-04, a sender new to a thread: msg_id, variant, host, previous.

    Earlier messages of the thread are those before by (ts, msg_id). Only the
    first message of an address in a thread can be one, and facts about a
    thread's past are least times by (thread, domain), (thread, name) and so
    on. So everything is grouping and equal keys, however long a thread is:
    no window over its rows, and no pairs of its messages.
    """
    e = emails.where("thread IS NOT NULL").select("msg_id", "thread", F.lower("from_address").alias("address"), domain_of(F.col("from_address")).alias("domain"), F.nullif(key(F.col("from_name")), F.lit("")).alias("name"), F.struct("ts", "msg_id").alias("at"))
    # Read some ten times below.
    e = written(e.where("domain IS NOT NULL").withColumn("site", h.registrable_domain(F.col("domain"))), "thread-mail")
    # Every side below grows with the mail, and its files are far smaller than its rows: none is broadcast.
    # What is joined is written first, so that no plan holds all of it, which the driver would plan anew after each shuffle.
    first = lambda *by: written(e.groupBy("thread", *by).agg(F.min("at").alias("since")), "thread-first").hint("merge")
    by_site = first("site")
    new = e.join(first("address"), ["thread", "address"]).where("at = since").drop("since")
    new = written(new.join(by_site, ["thread", "site"]).where("at = since").drop("since"), "thread-new")
    alike = domains.relations(e.select(F.col("domain").alias("host")), e.select("domain"))
    alike = written(alike.where(domains.compared(F.col("relation")) == "lookalike").select(F.col("host").alias("domain"), F.col("trusted").alias("previous")), "alike").hint("merge")
    imitated = new.join(alike, "domain").join(first("domain").withColumnRenamed("domain", "previous"), ["thread", "previous"]).where("since < at").groupBy("msg_id").agg(F.min_by("previous", "since").alias("imitated"))
    imitated = written(imitated, "thread-imitated")
    named = written(e.where("name IS NOT NULL").groupBy("thread", "name").agg(F.min("at").alias("since"), F.min_by("domain", "at").alias("same_name")), "thread-named")
    sites = written(by_site.groupBy("thread").agg(F.min("since").alias("one_since"), F.min_by("site", "since").alias("one")), "thread-sites")
    second = by_site.join(sites.hint("merge"), "thread").where("since > one_since").groupBy("thread").agg(F.min("since").alias("two_since"))
    sites = written(sites.join(second.hint("merge"), "thread", "left"), "thread-sites")
    new = new.join(imitated.hint("merge"), "msg_id", "left").join(named.hint("merge"), ["thread", "name"], "left").join(sites.hint("merge"), "thread").where("one_since < at")
    by_name = F.when(F.col("since") < F.col("at"), F.col("same_name"))
    only = F.when(F.col("two_since").isNull() | (F.col("two_since") >= F.col("at")), F.col("one"))
    variant = F.when(F.col("imitated").isNotNull(), "lookalike").when(by_name.isNotNull(), "same_name_new_domain").when(only.isNotNull(), "different_domain")
    return new.select("msg_id", variant.alias("variant"), F.col("domain").alias("host"), F.coalesce("imitated", by_name, only).alias("previous")).where("variant IS NOT NULL")


def organisation_relations(hosts: DataFrame, org: Organisation) -> DataFrame:
    """host, relation ('same' or 'lookalike'), technique of hosts that are the organisation's or imitate its domains or tokens."""
    spark = hosts.sparkSession
    refs = spark.createDataFrame([(d, True) for d in org.domains] + [(f"{t}.invalid", False) for t in org.tokens], "domain string, own boolean")
    r = domains.relations(hosts, refs).join(refs, F.col("trusted") == F.col("domain"))
    rank = F.array_position(F.array(*[F.lit(x) for x in TECHNIQUE_ORDER]), F.col("relation"))
    r = r.groupBy("host").agg(F.bool_or(F.col("own") & F.col("relation").isin("same", "sibling")).alias("same"), F.min(F.when(rank > 0, rank)).alias("rank"))
    technique = F.element_at(F.array(*[F.lit(x) for x in TECHNIQUE_ORDER]), F.col("rank").cast("int"))
    return r.where("same OR rank IS NOT NULL").select("host", F.when(F.col("same"), "same").otherwise("lookalike").alias("relation"), F.when(~F.col("same"), technique).alias("technique"))


def strong_imitation(host: Column, relation: Column, technique: Column, claims: Column) -> Column:
    """Whether a host's likeness to the organisation is worth a report: an embedded brand alone is only with a lure or a claim."""
    lure = F.arrays_overlap(F.split(h.registrable_label(host), "-"), F.array(*[F.lit(x) for x in LURES]))
    return F.coalesce((relation == "lookalike") & ((technique != "brand_embedded") | lure | claims), F.lit(False))


def mentions(name: Column, org: Organisation) -> Column:
    """Whether a display name has the organisation's name or a token, as words or run together."""
    out, k = F.lit(False), key(name)
    for word in [org.name, *org.tokens]:
        plain = " ".join("".join(c if c.isalnum() else " " for c in word.lower()).split())
        if len(plain) >= 4:
            out = out | F.contains(F.concat(F.lit(" "), k, F.lit(" ")), F.lit(f" {plain} ")) | F.contains(F.replace(k, F.lit(" "), F.lit("")), F.lit(plain.replace(" ", "")))
    return out


def _role(text: Column, keys: list[tuple[str, str]]) -> Column:
    """Function of the first role whose key stands in a text as whole words."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    return F.coalesce(F.lit(None).cast("string"), *[F.when(F.contains(padded, F.lit(f" {k} ")), function) for function, k in keys])


def prepared(emails: DataFrame, suppliers: DataFrame, org: Organisation) -> DataFrame:
    """Emails with what is known of their sender: domain, org_relation, technique, internal, claims, supplier (its row as a struct), claimed_supplier, owned, likeness.

    ``suppliers`` has supplier_id (the order that ties go by), name, domains,
    accounts, beneficiaries, addresses (arrays). A supplier is claimed by the
    display name, else by the subject of an outsider, else by a domain that
    imitates one; else it is the sender's own.
    """
    e = emails.withColumn("domain", domain_of(F.col("from_address")))
    # Tables by host or email, written so that no plan holds all of their making. They grow with hosts, mail or suppliers, so none is broadcast.
    hosts = written(e.select(F.col("domain").alias("host")).where("host IS NOT NULL").distinct(), "mail-hosts")
    org_rel = written(organisation_relations(hosts, org).select(F.col("host").alias("domain"), F.col("relation").alias("org_relation"), "technique"), "mail-org").hint("merge")
    e = e.join(org_rel, "domain", "left").withColumn("internal", F.coalesce(F.col("org_relation") == "same", F.lit(False))).withColumn("claims", mentions(F.col("from_name"), org))
    owned = suppliers.select("supplier_id", F.explode("domains").alias("domain"))
    pairs = domains.relations(hosts, owned.select("domain")).join(owned.select("supplier_id", F.col("domain").alias("trusted")).hint("merge"), "trusted")
    pairs = pairs.select(F.col("host").alias("domain"), "supplier_id", "relation", domains.compared(F.col("relation")).alias("compared"))
    best = written(pairs.groupBy("domain", "supplier_id").agg(F.bool_or(F.col("compared").isin("same", "sibling")).alias("owns"), F.bool_or(F.col("compared") == "lookalike").alias("imitates"), F.bool_or(F.col("relation") == "brand_embedded").alias("embeds")), "mail-suppliers").hint("merge")
    sender = best.groupBy("domain").agg(F.min(F.when(F.col("owns"), F.col("supplier_id"))).alias("own_id"), F.min(F.when(F.col("imitates"), F.col("supplier_id"))).alias("like_id"))
    names = suppliers.select(F.col("supplier_id").alias("name_id"), "name")
    named = lambda column, out: written(containment.names_in(emails.select(F.col("msg_id").alias("text_id"), F.col(column).alias("text")), names).groupBy(F.col("text_id").alias("msg_id")).agg(F.min("name_id").alias(out)), out).hint("merge")
    e = e.join(sender, "domain", "left").join(named("from_name", "name_id"), "msg_id", "left").join(named("subject", "subject_id"), "msg_id", "left")
    said = F.coalesce("name_id", F.when(~F.col("internal"), F.col("subject_id")), F.when(F.col("own_id").isNull(), F.col("like_id")))
    e = e.withColumn("claimed_supplier", said).withColumn("supplier_id", F.coalesce("claimed_supplier", "own_id")).drop("own_id", "like_id", "name_id", "subject_id")
    e = e.join(best.select("domain", "supplier_id", "owns", "imitates", "embeds"), ["domain", "supplier_id"], "left")
    known = suppliers.select("supplier_id", F.struct("name", "domains", "accounts", "beneficiaries", "addresses").alias("supplier"))
    return e.join(known.hint("merge"), "supplier_id", "left").withColumn("owned", F.coalesce("owns", F.lit(False)))


def signals(emails: DataFrame, suppliers: DataFrame, org: Organisation, registry: list[Institution], financial: DataFrame) -> DataFrame:
    """EMAIL-* and ORG-* signals: msg_id, place, code, variant, host, evidence.

    ``financial`` lists messages (msg_id) that ask for money. Each code comes
    once a message.
    """
    e = prepared(emails, suppliers, org).join(financial.select("msg_id", F.lit(True).alias("asks")).distinct().hint("merge"), "msg_id", "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
    e = dealt(written(e, "mail"), EMAILS_A_TASK, "msg_id")
    domain, s = F.col("domain"), F.col("supplier")
    # Columns that several rules read are computed once a row; else each rule, and the plan, would hold a copy.
    rows = offsets.computed(e, _bank=claimed(F.coalesce("from_name", F.lit("")), registry), _free=freemail(domain), _key=key(F.col("from_name")), _words=containment.name_words(F.col("from_name")), _shown=F.lower(F.regexp_extract(F.coalesce("from_name", F.lit("")), EMBEDDED_ADDRESS, 1)))
    row = lambda place, code, when, variant=None, host=None, evidence=None: F.when(when, F.struct(F.lit(place).alias("place"), F.lit(code).alias("code"), F.lit(variant).cast("string").alias("variant") if variant is None or isinstance(variant, str) else variant.alias("variant"), (F.lit(None).cast("string") if host is None else host).alias("host"), (F.lit(None).cast("string") if evidence is None else evidence).alias("evidence")))
    address = F.lower("from_address")
    # EMAIL-02: a known supplier's name, not its domain.
    mismatch = F.col("claimed_supplier").isNotNull() & domain.isNotNull() & ~F.col("owned") & ~F.col("internal")
    two = F.when(F.col("imitates"), "lookalike").when(F.col("embeds"), "brand_embedded").when(F.col("_free"), "freemail").otherwise("unrelated")
    failed = authentication(F.col("spf"), F.col("dkim"), F.col("dmarc"), F.col("owned") | F.col("internal"))
    risks = F.transform(F.coalesce("attachments", F.array().cast("array<struct<name:string,type:string>>")), lambda a: F.struct(F.array_position(F.array(F.lit("risky_type"), F.lit("type_mismatch"), F.lit("double_extension")), attachment_risk(a["name"], a["type"])).alias("r"), attachment_risk(a["name"], a["type"]).alias("v"), a["name"].alias("n")))
    # Types that disguise themselves are equally bad; the first of the worst counts.
    bad = F.col("_bad")
    worst = F.coalesce(F.get(F.filter(bad, lambda x: x["r"] > 1), F.lit(0)), F.get(bad, F.lit(0)))
    asked = F.array_distinct(F.concat(account_ends(F.col("text")), F.when(F.col("pay_last4").isNotNull(), F.array("pay_last4")).otherwise(F.array().cast("array<string>"))))
    changed = F.get(F.filter(asked, lambda x: ~F.array_contains(s["accounts"], x)), F.lit(0))
    to = F.coalesce("pay_recipient", payee(F.col("text")))
    people = [(" ".join(sorted(set(key_of(n).split()))), role, [a.lower() for a in addresses]) for n, role, addresses in org.people]
    words = F.col("_words")
    person = F.coalesce(F.lit(None).cast("struct<role:string,mine:boolean>"), *[F.when(F.size(F.array_except(F.array(*[F.lit(w) for w in k.split()]), words)) == 0, F.struct(F.lit(role).alias("role"), address.isin(addresses).alias("mine"))) for k, role, addresses in people if len(k.split()) >= 2])
    impersonates = domain.isNotNull() & ~F.col("internal") & F.col("_person").isNotNull() & ~F.col("_person.mine")
    org_like = F.coalesce((F.col("org_relation") == "lookalike") & (F.col("technique") != "brand_embedded"), F.lit(False))
    shown, bank = F.col("_shown"), F.col("_bank")
    theirs = F.lit(False)
    for i in registry:
        own = F.lit(False)
        for d in i.official:
            own = own | h.official(domain, F.lit(d))
        theirs = F.when(bank == i.ord, own).otherwise(theirs)
    eight = F.when((shown != "") & (h.registrable_domain(shown) != h.registrable_domain(domain)), "embedded_address").when(bank.isNotNull() & ~theirs, "institution_name").when(F.rlike(F.coalesce("from_name", F.lit("")), F.lit(SENIOR_TITLE)) & F.col("_free"), "title_on_freemail")
    # ORG-01 and ORG-03: our own domain or functions, from outside.
    imitation = domain.isNotNull() & ~F.col("internal") & strong_imitation(domain, F.col("org_relation"), F.col("technique"), F.col("claims"))
    by_name = _role(F.col("_key"), [(f, key_of(label)) for f, labels, _ in org.roles for label in labels])
    local = F.substring_index(address, "@", 1)
    by_local = F.coalesce(F.lit(None).cast("string"), *[F.when(local.isin([a.lower().split("@")[0] for a in addresses]), f) for f, _, addresses in org.roles if addresses])
    rows = offsets.computed(rows, _bad=F.filter(risks, lambda x: x["r"] > 0), _changed=changed, _to=to, _person=person, _eight=eight, _imitation=imitation, _by_name=by_name, _by_local=by_local, _failed=failed)
    rows = offsets.computed(rows, _worst=worst)
    failed, worst, changed, to, eight, imitation, by_name, by_local = (F.col(c) for c in ("_failed", "_worst", "_changed", "_to", "_eight", "_imitation", "_by_name", "_by_local"))
    plausible = F.col("claims") | imitation | F.col("_free") | (by_local.isNotNull() & by_name.isNotNull())
    role = domain.isNotNull() & ~F.col("internal") & F.coalesce(by_name, by_local).isNotNull() & ~F.col("owned") & plausible
    full = lambda c: F.size(F.coalesce(s[c], F.array().cast("array<string>"))) > 0
    ladder = rows.select("msg_id", F.inline(F.array_compact(F.array(
        row(1, "EMAIL-02", mismatch, two, domain, address),
        row(3, "EMAIL-03", failed.isNotNull(), failed, None, F.concat_ws(" / ", "spf", "dkim", "dmarc")),
        row(5, "EMAIL-05", worst.isNotNull(), worst["v"], None, worst["n"]),
        row(6, "EMAIL-06", s.isNotNull() & full("accounts") & changed.isNotNull(), None, None, F.concat(F.lit("account ending "), changed)),
        row(7, "EMAIL-07", s.isNotNull() & full("beneficiaries") & to.isNotNull() & ~F.exists(s["beneficiaries"], lambda b: names_match(to, b, registry)), None, None, to),
        row(8, "EMAIL-10", F.col("asks") & F.col("owned") & full("addresses") & ~F.array_contains(s["addresses"], address), None, None, address),
        row(9, "EMAIL-09", impersonates, F.when(F.col("_person.role") == "executive", "executive").otherwise("employee"), domain, address),
        row(10, "EMAIL-08", domain.isNotNull() & F.col("from_name").isNotNull() & ~mismatch & ~impersonates & ~org_like & eight.isNotNull(), eight, domain, address),
        row(20, "ORG-01", imitation, F.col("technique"), domain, address),
        row(21, "ORG-03", role, F.coalesce(by_name, by_local), domain, address),
    ))))
    four = written(thread_changes(e), "threads")
    four = four.select("msg_id", F.lit(4).alias("place"), F.lit("EMAIL-04").alias("code"), "variant", "host", F.col("previous").alias("evidence"))
    return written(ladder, "mail-ladder").unionAll(four).unionAll(written(reply_changes(e, org), "replies")).unionAll(first_contacts(e))


def key_of(name: str) -> str:
    """``key`` of a literal."""
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFKD", name.lower()) if not unicodedata.combining(c))
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in plain).split())


def reply_changes(e: DataFrame, org: Organisation) -> DataFrame:
    """EMAIL-01, the first Reply-To on another site than the sender's: one of ``signals``. ``e`` is ``prepared``.

    A Reply-To on a domain of the same supplier or of the organisation itself
    is none. In a thread where the sender wrote before, the variant says so.
    """
    r = e.where("domain IS NOT NULL AND size(reply_to) > 0").select("msg_id", "thread", "ts", "domain", F.lower("from_address").alias("address"), "internal", "owned", F.col("supplier.domains").alias("own"), F.posexplode("reply_to").alias("k", "reply"))
    r = r.withColumn("reply_domain", domain_of(F.col("reply"))).where("reply_domain IS NOT NULL").where(h.registrable_domain(F.col("reply_domain")) != h.registrable_domain(F.col("domain")))
    same_party = F.col("owned") & F.exists(F.coalesce("own", F.array().cast("array<string>")), lambda d: h.official(F.col("reply_domain"), d) | (h.registrable_domain(F.col("reply_domain")) == h.registrable_domain(d)))
    ours = organisation_relations(r.select(F.col("reply_domain").alias("host")), org).where("relation = 'same'").select(F.col("host").alias("reply_domain"), F.lit(True).alias("ours")).hint("merge")
    r = r.join(ours, "reply_domain", "left").where(~F.coalesce(same_party, F.lit(False)) & ~(F.col("internal") & F.coalesce("ours", F.lit(False))))
    r = r.groupBy("msg_id", "thread", "ts", "address").agg(F.min_by("reply_domain", "k").alias("host"))
    since = e.where("thread IS NOT NULL").groupBy("thread", F.lower("from_address").alias("address")).agg(F.min(F.struct("ts", "msg_id")).alias("since")).hint("merge")
    r = r.join(since, ["thread", "address"], "left")
    return r.select("msg_id", F.lit(2).alias("place"), F.lit("EMAIL-01").alias("code"), F.when(F.col("since") < F.struct("ts", "msg_id"), "in_thread").alias("variant"), "host", F.col("host").alias("evidence"))


def first_contacts(e: DataFrame) -> DataFrame:
    """ORG-04, an outsider who first wrote to this mailbox less than seven days ago or just now: one of ``signals``. ``e`` is ``prepared``."""
    s = e.where("recipient IS NOT NULL AND domain IS NOT NULL").select("msg_id", "ts", "internal", F.lower("from_address").alias("address"), F.lower("recipient").alias("recipient"))
    since = s.groupBy("address", "recipient").agg(F.min("ts").alias("since")).hint("merge")
    s = s.where("NOT internal").join(since, ["address", "recipient"]).where(F.col("ts") - F.col("since") < FIRST_CONTACT_SECONDS)
    return s.select("msg_id", F.lit(22).alias("place"), F.lit("ORG-04").alias("code"), F.lit(None).cast("string").alias("variant"), F.lit(None).cast("string").alias("host"), F.col("address").alias("evidence"))
