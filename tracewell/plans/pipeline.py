"""Messages to verdicts: detectors' outputs as one ordered relation of signals, then scores and plans.

Each detector gives rows (msg_id, place, code, and what else it knows);
``union`` brings them to one schema. A signal's ``ord`` is its detector's
turn and its place there, so no window is needed to number them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.plans import scoring
from tracewell.plans.ruleset import Ruleset, ruleset
from tracewell.sources.scratch import dealt, written

# Results depend on them.
#: Detectors in the order in which their signals arrive.
DETECTORS = ["urls", "homoglyphs", "client_urls", "hygiene", "threat", "identity", "forms", "lexicon", "injection", "template", "payment", "email", "organisation", "extra", "semantic", "reputation", "org_intel", "community"]
SOURCE_TYPES = ["rule", "lexicon", "intel", "semantic_model", "community"]
#: Codes without points, which are known all the same.
UNSCORED = ["URL-09", "URL-11", "CERT-01", "CERT-02"]
#: Categories of risk, and those of codes by their first part; codes that differ are listed by themselves.
CATEGORIES = ["identity_risk", "behavioral_risk", "payment_risk", "technical_risk", "verification_risk"]
CATEGORY_OF = {
    "URL": "technical_risk", "CERT": "technical_risk", "ID": "identity_risk", "SOC": "behavioral_risk", "PAY": "payment_risk", "SEC": "payment_risk", "REP": "verification_risk", "ORG": "identity_risk", "DOC": "technical_risk",
    "EMAIL-01": "identity_risk", "EMAIL-02": "identity_risk", "EMAIL-03": "technical_risk", "EMAIL-04": "identity_risk", "EMAIL-05": "technical_risk", "EMAIL-06": "payment_risk", "EMAIL-07": "payment_risk", "EMAIL-08": "identity_risk", "EMAIL-09": "identity_risk", "EMAIL-10": "payment_risk",
    "ORG-02": "technical_risk", "ORG-05": "verification_risk", "ORG-06": "verification_risk",
}
#: The usual severity of codes; codes that aren't listed are medium.
SEVERITY = {
    "low": ["URL-05", "SOC-01", "SOC-04", "SOC-05", "SOC-09", "PAY-01", "EMAIL-01", "EMAIL-03", "EMAIL-05", "EMAIL-10", "ORG-04", "DOC-01", "DOC-03", "DOC-12"],
    "high": [
        "URL-01", "URL-02", "URL-03", "URL-04", "URL-07", "URL-10", "CERT-01", "ID-01", "ID-02", "ID-05", "SOC-07", "SOC-10", "PAY-02", "PAY-03", "PAY-05", "PAY-06", "SEC-01", "SEC-02", "SEC-03",
        "REP-02", "REP-04", "REP-05", "EMAIL-06", "EMAIL-07", "EMAIL-09", "ORG-01", "ORG-02", "ORG-05", "DOC-05", "DOC-07", "DOC-09",
    ],
}
#: What an image check's name says, as a code; its confidence becomes the variant.
IMAGE_CHECKS = {"trufor": "DOC-09", "error_level_analysis": "DOC-10", "layout_comparison": "DOC-11", "metadata_pdf": "DOC-12", "signature_consistency": "DOC-13"}
#: The stage that findings imply, the first that applies.
STAGES = [("OTP_REQUEST", ["SEC-01"]), ("CREDENTIAL_REQUEST", ["SEC-02"]), ("PAYMENT_REQUEST", ["PAY-01", "PAY-02", "PAY-03", "PAY-04", "PAY-05", "PAY-07", "EMAIL-06", "EMAIL-07"])]
# End of the fixed values.

_COLUMNS = {"variant": "string", "host": "string", "evidence": "string", "start": "long", "severity": "string"}


def signal_rows(rows: DataFrame, detector: str, source_type: str | Column = "rule") -> DataFrame:
    """A detector's rows as signals: msg_id, ord, detector, code, source_type, variant, host, evidence, start, severity; missing ones are null."""
    kind = F.lit(source_type) if isinstance(source_type, str) else source_type
    place = F.coalesce(F.col("place").cast("long"), F.lit(0)) if "place" in rows.columns else F.lit(0)
    more = [(F.col(c) if c in rows.columns else F.lit(None)).cast(k).alias(c) for c, k in _COLUMNS.items()]
    return rows.select("msg_id", (F.lit(DETECTORS.index(detector) << 40).cast("long") + place).alias("ord"), F.lit(detector).alias("detector"), "code", kind.alias("source_type"), *more)


def union(parts: dict[str, DataFrame | tuple[DataFrame, str | Column]]) -> DataFrame:
    """All signals of all detectors; a part is rows, or rows and their source type. Repeated signals stay."""
    out = None
    for name, part in parts.items():
        rows = signal_rows(part[0], name, part[1]) if isinstance(part, tuple) else signal_rows(part, name)
        out = rows if out is None else out.unionByName(rows)
    return out


def gathered(parts: dict[str, DataFrame | tuple[DataFrame, str | Column]], name: str) -> DataFrame:
    """``union``, with each detector's rows written by a job of its own, so that no plan holds all detectors, and read back together."""
    return union({k: ((written(p[0], f"{name}-{k}"), p[1]) if isinstance(p, tuple) else written(p, f"{name}-{k}")) for k, p in parts.items()})


def codes(rules: Ruleset) -> list[str]:
    return sorted({code for code, *_ in rules.weight_rows()} | set(UNSCORED))


def checked(signals: DataFrame, rules: Ruleset) -> DataFrame:
    """The signals; the job fails on one whose code or source type isn't in the closed sets."""
    known = F.col("code").isin(codes(rules)) & F.col("source_type").isin(SOURCE_TYPES)
    wrong = F.concat(F.lit("unknown signal: "), F.coalesce("code", F.lit("null")), F.lit(" of "), F.coalesce("source_type", F.lit("null")))
    return signals.withColumn("code", F.when(F.coalesce(known, F.lit(False)), F.col("code")).otherwise(F.raise_error(wrong)))


def accepted(extra: DataFrame, rules: Ruleset) -> DataFrame:
    """Signals from outside that count: known codes, never as the model's inference."""
    return extra.where(F.col("code").isin(codes(rules)) & (F.col("source_type") != "semantic_model"))


def image_signals(indicators: DataFrame) -> DataFrame:
    """Image checks (msg_id, place, check, confidence, evidence) as extra signals; unknown checks give none."""
    pairs = F.create_map(*[F.lit(x) for kv in IMAGE_CHECKS.items() for x in kv])
    out = indicators.withColumn("code", pairs[F.col("check")]).where("code IS NOT NULL")
    return out.select("msg_id", "place", "code", F.lit("rule").alias("source_type"), F.col("confidence").alias("variant"), "evidence", F.col("confidence").alias("severity"))


def annotated(members: DataFrame) -> DataFrame:
    """Which signal carries each finding's points: msg_id, ord, code, grp, scored, merged_into (the primary's code; null for it).

    ``members`` is scoring.members of the signals.
    """
    # A window over what members has sorted already; a join would make the members twice.
    primary = F.max(F.when(F.col("place") == 1, F.col("code"))).over(Window.partitionBy("msg_id", "grp"))
    out = members.where("grp IS NOT NULL").withColumn("primary", primary)
    return out.select("msg_id", "ord", "code", "grp", (F.col("place") == 1).alias("scored"), F.when(F.col("place") > 1, F.col("primary")).alias("merged_into"))


def stage(code_set: Column) -> Column:
    """The stage that a set of codes implies, or null."""
    out = F.lit(None).cast("string")
    for name, some in reversed(STAGES):
        out = F.when(F.arrays_overlap(code_set, F.array(*[F.lit(c) for c in some])), name).otherwise(out)
    return out


def category(code: Column) -> Column:
    own = F.create_map(*[F.lit(x) for kv in CATEGORY_OF.items() for x in kv])
    return F.coalesce(own[code], own[F.substring_index(code, "-", 1)])


def severity(code: Column, given: Column) -> Column:
    """The severity that a signal brings, else its code's usual one."""
    return F.coalesce(given, F.when(code.isin(SEVERITY["low"]), "low").when(code.isin(SEVERITY["high"]), "high").otherwise("medium"))


def categories(signals: DataFrame, contexts: DataFrame) -> DataFrame:
    """The worst severity of each category of risk, LOW without any: msg_id and one column a category.

    Community evidence says nothing about the message, so it is left out.
    """
    rank = F.array_position(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), severity(F.col("code"), F.col("severity")))
    s = signals.where("detector <> 'community'").select("msg_id", category(F.col("code")).alias("category"), rank.alias("r"))
    worst = s.groupBy("msg_id").agg(*[F.max(F.when(F.col("category") == c, F.col("r"))).alias(c) for c in CATEGORIES])
    name = lambda c: F.element_at(F.array(F.lit("LOW"), F.lit("MEDIUM"), F.lit("HIGH")), F.greatest(F.coalesce(F.col(c), F.lit(1)), F.lit(1)).cast("int")).alias(c)
    return contexts.select("msg_id").join(worst.hint("merge"), "msg_id", "left").select("msg_id", *[name(c) for c in CATEGORIES])


def assess(signals: DataFrame, contexts: DataFrame, version: str | None = None) -> DataFrame:
    """One row per context: what scoring.score says, and stage and codes of all members.

    ``contexts`` has msg_id, claimed (an institution is named) and
    semantic_ok.
    """
    rules = ruleset(version) if version else ruleset()
    s = checked(dealt(signals, scoring.SIGNALS_A_TASK, "msg_id"), rules)
    found = scoring.score(s.select("msg_id", "ord", "code", "source_type", F.coalesce("variant", F.lit("")).alias("variant"), "host"), contexts, version)
    seen = s.groupBy("msg_id").agg(F.sort_array(F.collect_set("code")).alias("codes"))
    return found.join(seen.hint("merge"), "msg_id", "left").withColumn("stage", stage(F.col("codes"))).withColumn("codes", F.coalesce(F.array_join("codes", ","), F.lit("")))


def batch_summary(assessed: DataFrame) -> DataFrame:
    """One row: total, scam, suspicious, safe and unanalysed messages."""
    return assessed.agg(F.count("*").alias("total"), *[F.count_if(F.col("verdict") == v).alias(v) for v in ("scam", "suspicious", "safe")], F.count_if(F.col("verdict").isNull()).alias("unanalysed"))
