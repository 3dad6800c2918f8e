"""Response headers and cookies: parsing, and findings about them.

Responses have id, protocol, headers (a map with lower-case names) and cookies
(an array of Set-Cookie values).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Results depend on them.
SCHEME_SOURCE = r"^(?:https?|data|blob|filesystem):$"
NONCE_OR_HASH = r"^'(?:nonce|sha256|sha384|sha512)-"
#: Seconds of strict transport security below which it is short.
MIN_HSTS = 15_552_000
BANNERS = ["server", "x-powered-by", "x-aspnet-version", "x-aspnetmvc-version", "x-generator"]
SENSITIVE_COOKIE = r"(?i)session|auth|token|sid\b|jwt|login"
MAX_COOKIES = 10
# End of the fixed values.

_DIRECTIVES = "map<string,array<string>>"
_COOKIE = "name string, secure boolean, http_only boolean, same_site string"


def policy(value: Column) -> Column:
    """Directives of a content security policy: name to sources, lower-case; of one named twice the first counts. Joined policies are read as one."""
    parts = F.flatten(F.transform(F.split(F.lower(F.coalesce(value, F.lit(""))), ","), lambda p: F.split(p, ";")))
    words = F.filter(F.transform(parts, lambda p: F.split(F.trim(F.regexp_replace(p, r"\s+", " ")), " ")), lambda w: w[0] != "")
    put = lambda m, w: F.when(F.map_contains_key(m, w[0]), m).otherwise(F.map_concat(m, F.create_map(w[0], F.slice(w, F.lit(2), F.size(w)))))
    return F.aggregate(words, F.create_map().cast(_DIRECTIVES), put)


def cookie(raw: Column) -> Column:
    """(name, secure, http_only, same_site) of a Set-Cookie value; same_site is null if there is none."""
    parts = F.transform(F.split(raw, ";"), lambda p: F.trim(p))
    rest = F.slice(parts, F.lit(2), F.size(parts))
    names = F.transform(rest, lambda p: F.lower(F.substring_index(p, "=", 1)))
    same = F.get(F.filter(rest, lambda p: F.startswith(F.lower(p), F.lit("samesite="))), F.lit(0))
    return F.struct(F.trim(F.substring_index(parts[0], "=", 1)).alias("name"), F.array_contains(names, "secure").alias("secure"), F.array_contains(names, "httponly").alias("http_only"), F.trim(F.get(F.split(same, "="), F.lit(1))).alias("same_site"))


def _open(source: Column) -> Column:
    return (source == "*") | F.rlike(source, F.lit(SCHEME_SOURCE))


def _finding(category: str, kind: str | Column, severity: str | Column, when: Column, evidence: Column | None = None) -> Column:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(category).alias("category"), text(kind).alias("kind"), text(severity).alias("severity"), (F.lit(None).cast("string") if evidence is None else evidence).alias("evidence")))


def findings(responses: DataFrame) -> DataFrame:
    """id, category, kind, severity, evidence: nine checks of what a response's headers say or leave out.

    Policy, strict transport (only over https), content types, referrers,
    permissions, opener, framing (a policy's frame-ancestors comes before
    X-Frame-Options), sharing between origins, banners, cookies (the first
    ten). Headers that are empty count as missing; a null map as no headers.
    """
    r = responses.withColumn("_h", F.coalesce("headers", F.create_map().cast("map<string,string>"))).withColumn("_csp", policy(F.col("_h")["content-security-policy"]))
    # One row a response in which the parsed policy is at hand, computed once.
    r = r.select("id", "protocol", "cookies", "_h", F.inline(F.array(F.struct(F.col("_csp").alias("csp")))))
    head = lambda name: F.nullif(F.col("_h")[name], F.lit(""))
    missing = lambda name, severity: _finding("headers", f"missing {name}", severity, head(name).isNull())
    secure = F.col("protocol") == "https:"
    value, script = head("content-security-policy"), F.coalesce(F.col("csp")["script-src"], F.col("csp")["default-src"])
    has = value.isNotNull()
    inline = F.array_contains(script, "'unsafe-inline'") & ~F.exists(script, lambda s: F.rlike(s, F.lit(NONCE_OR_HASH)))
    frame, xfo = F.col("csp")["frame-ancestors"], F.trim(head("x-frame-options"))
    hsts = head("strict-transport-security")
    age = F.coalesce(F.nullif(F.regexp_extract(hsts, r"(?i)max-age=(\d+)", 1), F.lit("")).cast("decimal(38,0)"), F.lit(0))
    origin, allowed = F.trim(head("access-control-allow-origin")), F.coalesce(F.lower(F.trim(head("access-control-allow-credentials"))) == "true", F.lit(False))
    banners = F.filter(F.array(*[F.struct(F.lit(n).alias("n"), F.trim(head(n)).alias("v")) for n in BANNERS]), lambda b: b["v"].isNotNull() & (b["v"] != "") & ((b["n"] != "server") | F.rlike(b["v"], F.lit(r"\d"))))
    content = head("x-content-type-options")
    one = F.array(
        _finding("headers", "policy report-only", "low", ~has & head("content-security-policy-report-only").isNotNull()),
        _finding("headers", "missing policy", "medium", ~has & head("content-security-policy-report-only").isNull()),
        _finding("headers", "policy without scripts", "medium", has & script.isNull(), F.left(value, F.lit(200))),
        _finding("headers", "policy allows inline scripts", "medium", has & inline, F.left(value, F.lit(200))),
        _finding("headers", "policy allows eval", "medium", has & F.array_contains(script, "'unsafe-eval'"), F.left(value, F.lit(200))),
        _finding("headers", "policy allows any script host", "medium", has & ~F.array_contains(script, "'strict-dynamic'") & F.exists(script, _open), F.left(value, F.lit(200))),
        _finding("headers", "policy without plugins", "low", has & F.coalesce(F.col("csp")["object-src"], F.col("csp")["default-src"]).isNull(), F.left(value, F.lit(200))),
        _finding("headers", "policy without base-uri", "low", has & ~F.map_contains_key("csp", "base-uri"), F.left(value, F.lit(200))),
        _finding("headers", "missing strict-transport-security", "medium", secure & hsts.isNull()),
        _finding("headers", "short strict transport", "low", secure & hsts.isNotNull() & (age < MIN_HSTS), F.left(hsts, F.lit(200))),
        _finding("headers", "strict transport without subdomains", "info", secure & hsts.isNotNull() & (age >= MIN_HSTS) & ~F.contains(F.lower(hsts), F.lit("includesubdomains")), F.left(hsts, F.lit(200))),
        missing("x-content-type-options", "low"),
        _finding("headers", "odd content type option", "low", F.lower(F.trim(content)) != "nosniff", F.left(content, F.lit(200))),
        missing("referrer-policy", "info"),
        _finding("headers", "permissive referrer policy", "low", F.lower(F.trim(head("referrer-policy"))) == "unsafe-url", F.left(head("referrer-policy"), F.lit(200))),
        missing("permissions-policy", "info"),
        missing("cross-origin-opener-policy", "info"),
        _finding("framing", "any site may frame by policy", "medium", F.exists(frame, _open), F.array_join(frame, " ")),
        _finding("framing", "any site may frame", "medium", frame.isNull() & xfo.isNull()),
        _finding("framing", "allow-from is ignored", "medium", frame.isNull() & F.startswith(F.lower(xfo), F.lit("allow-from")), xfo),
        _finding("framing", "odd framing option", "low", frame.isNull() & ~F.rlike(xfo, F.lit("(?i)^(?:deny|sameorigin)$|^allow-from")), xfo),
        _finding("cors", "null origin trusted", "medium", origin == "null", origin),
        _finding("cors", "any origin with credentials", "medium", (origin == "*") & allowed, origin),
        _finding("cors", "any origin", "info", (origin == "*") & ~allowed, origin),
        _finding("disclosure", "server software version", "low", F.size(banners) > 0, F.array_join(F.transform(banners, lambda b: F.concat(b["n"], F.lit(": "), F.left(b["v"], F.lit(80)))), "; ")),
    )

    def of_cookie(c: Column) -> Column:
        same = F.lower(c["same_site"])
        return F.array(
            _finding("cookies", F.concat(F.lit("not secure: "), c["name"]), "medium", secure & ~c["secure"], c["name"]),
            _finding("cookies", F.concat(F.lit("readable by scripts: "), c["name"]), F.when(F.rlike(c["name"], F.lit(SENSITIVE_COOKIE)), "medium").otherwise("low"), ~c["http_only"], c["name"]),
            _finding("cookies", F.concat(F.lit("weak same-site: "), c["name"]), "medium", same.isNull() | (same == "") | ((same == "none") & ~c["secure"]), c["name"]),
        )

    jar = F.filter(F.transform(F.slice(F.coalesce("cookies", F.array().cast("array<string>")), 1, MAX_COOKIES), cookie), lambda c: c["name"] != "")
    both = F.array_compact(F.concat(one, F.flatten(F.transform(jar, of_cookie))))
    return r.select("id", F.inline(both))


def exposure_findings(probes: DataFrame, artifacts: list[tuple[str, str, str]]) -> DataFrame:
    """Findings of files that shouldn't be served: id, category, kind, severity, evidence.

    ``probes`` has id, path, status and body, what fixed paths answered;
    ``artifacts`` are (path, pattern of a body that proves it, severity). The
    probe of .well-known/security.txt is a finding when it isn't there.
    """
    text = F.coalesce("body", F.lit(""))
    served = F.lit(None).cast("string")
    for path, pattern, severity in artifacts:
        served = F.when((F.col("path") == path) & (F.col("status") == 200) & F.rlike(text, F.lit(pattern)), severity).otherwise(served)
    policy_file = (F.col("path") == ".well-known/security.txt") & ~((F.col("status") == 200) & F.rlike(text, F.lit(r"(?im)^contact:")))
    rows = F.array_compact(F.array(_finding("exposure", F.concat(F.lit("served: "), "path"), served, served.isNotNull(), F.col("path")), _finding("policy", "no security.txt", "info", policy_file)))
    return probes.select("id", F.inline(rows))
