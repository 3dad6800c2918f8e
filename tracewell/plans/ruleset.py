"""The versioned risk rulesets as small relations.

Each version is its predecessor's rows plus its own; older versions stay
readable, so a score can be replayed under the version that made it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# Scores depend on them, so they are stated as they must be.
BANDS = [("low", 0), ("elevated", 20), ("high", 45), ("critical", 70)]
CAP_SEMANTIC = 30
CAP_LEXICON = 40

#: code -> points, or {variant or source type: points} with "default".
WEIGHTS_1_0 = {
    "URL-01": 30, "URL-02": 30, "URL-03": 25, "URL-04": 25, "URL-05": 5, "URL-06": 20, "URL-07": 25, "URL-08": 10,
    "ID-01": 30, "ID-02": 25, "ID-03": 20, "ID-04": 12, "ID-05": 30,
    "SOC-01": {"lexicon": 6, "semantic_model": 8, "default": 6}, "SOC-02": 10,
    "SOC-03": {"lexicon": 15, "semantic_model": 12, "default": 15},
    "SOC-04": 8, "SOC-05": 8, "SOC-06": 12, "SOC-07": 25,
    "PAY-01": 8, "PAY-02": 25, "PAY-03": 35, "PAY-04": 15, "PAY-05": 25, "PAY-06": 30, "PAY-07": 20,
    "SEC-01": 30, "SEC-02": 30, "SEC-03": 30,
    "REP-01": 10, "REP-02": 20, "REP-03": 10, "REP-04": 40, "REP-05": 45,
}
WEIGHTS_1_1 = {
    "SOC-08": {"lexicon": 15, "semantic_model": 12, "default": 15},
    "EMAIL-01": 8,
    "EMAIL-02": {"lookalike": 30, "unrelated": 20, "default": 20},
    "EMAIL-03": {"dmarc_fail_known_domain": 15, "dmarc_fail": 8, "spf_and_dkim_fail": 6, "partial_fail": 3, "default": 3},
    "EMAIL-04": {"lookalike": 25, "different_domain": 8, "default": 8},
    "EMAIL-05": {"double_extension": 15, "type_mismatch": 15, "risky_type": 8, "default": 8},
    "EMAIL-06": 30, "EMAIL-07": 30,
    "EMAIL-08": {"embedded_address": 20, "institution_name": 20, "title_on_freemail": 12, "default": 12},
    "EMAIL-09": {"directory_name": 30, "lookalike_org_domain": 30, "default": 30},
    "EMAIL-10": 8,
}
WEIGHTS_1_2 = {"ORG-01": 30, "ORG-02": {"link": 25, "reply_to": 20, "default": 20}, "ORG-03": 12, "ORG-04": 3, "ORG-05": 40, "ORG-06": 10}
WEIGHTS_1_3 = {"SOC-09": {"lexicon": 8, "semantic_model": 8, "default": 8}}
WEIGHTS_1_4 = {
    "DOC-01": 10,
    "DOC-02": {"after_signature": 30, "incremental_update": 8, "default": 8},
    "DOC-03": 6,
    "DOC-04": {"transparent_overlay": 25, "resolution_mismatch": 20, "overlay": 10, "docx_transparent_image": 8, "default": 10},
    "DOC-05": 20, "DOC-06": 10,
    "DOC-07": {"javascript": 20, "launch_action": 30, "embedded_file": 10, "submit_form": 15, "macro": 30, "external_template": 30, "ole_object": 15, "default": 10},
    "DOC-08": 12,
}
WEIGHTS_1_5 = {"URL-10": 30}
WEIGHTS_1_6 = {
    "DOC-09": {"high": 30, "medium": 15, "low": 8, "default": 15},
    "DOC-10": {"high": 18, "medium": 10, "low": 5, "default": 10},
    "DOC-11": {"high": 15, "medium": 8, "low": 4, "default": 8},
    "DOC-12": {"high": 8, "medium": 5, "low": 3, "default": 5},
    "DOC-13": {"high": 15, "medium": 8, "low": 4, "default": 8},
    "SOC-10": 25,
}
#: Codes whose weights are keyed by source type; all other keyed ones are by variant.
BY_SOURCE = ("SOC-01", "SOC-03", "SOC-08", "SOC-09")
HOST_CODES_1_0 = ["URL-01", "URL-02", "URL-03", "URL-04", "URL-08", "ID-01"]
HOST_CODES_1_1 = ["EMAIL-02", "EMAIL-04", "EMAIL-08", "EMAIL-09"]
HOST_CODES_1_2 = ["ORG-01", "ORG-02", "ORG-03"]
IMPERSONATION = ["URL-01", "URL-02", "URL-03", "URL-04", "ID-01", "ID-02"]
#: From rs-1.1: the finding that takes another one in.
ABSORB = [("EMAIL-06", "PAY-07"), ("EMAIL-07", "PAY-05"), ("EMAIL-07", "ID-02")]

PAYMENT_CHANGE = ["PAY-01", "PAY-02", "PAY-05", "PAY-07", "EMAIL-06", "EMAIL-07"]
FORGERY_WITH = ["ID-01", "ID-02", "ID-03", "ID-04", "PAY-01", "PAY-02", "PAY-03", "PAY-04", "PAY-05", "PAY-06", "PAY-07"]
#: (id, points, group, a codes, a variants, b codes), in order of evaluation.
INTERACTIONS_1_0 = [
    ("IX-1", 15, None, ["ID-01", "ID-02", "ID-03", "ID-04", "URL-01", "URL-02", "URL-03", "URL-04"], None, ["PAY-01", "PAY-02", "PAY-03", "PAY-04", "PAY-05", "PAY-07", "SEC-01", "SEC-02"]),
    ("IX-2", 10, None, ["SOC-01", "SOC-02"], None, ["SEC-01"]),
    ("IX-3", 10, None, ["SOC-03"], None, ["PAY-01", "PAY-02", "PAY-03", "PAY-05", "PAY-07"]),
    ("IX-4", 10, None, ["SOC-05"], None, ["PAY-04"]),
    ("IX-5", 15, None, ["SOC-06"], None, ["PAY-02"]),
]
INTERACTIONS_1_1 = [
    ("EX-6", 15, "email-identity-payment", ["EMAIL-04"], None, ["PAY-07", "EMAIL-06", "EMAIL-07"]),
    ("EX-1", 15, "email-identity-payment", ["EMAIL-02"], None, PAYMENT_CHANGE),
    ("EX-3", 15, "email-identity-payment", ["EMAIL-09"], None, PAYMENT_CHANGE),
    ("EX-4", 10, None, ["EMAIL-01"], None, ["SEC-01", "URL-01", "URL-02", "URL-03", "URL-04"]),
    ("EX-5", 10, None, ["EMAIL-03"], ["dmarc_fail_known_domain"], PAYMENT_CHANGE),
]
INTERACTIONS_1_2 = [
    ("OX-1", 15, "email-identity-payment", ["ORG-01", "ORG-03"], None, [*PAYMENT_CHANGE, "SEC-01"]),
    ("OX-2", 10, None, ["ORG-06"], None, ["ORG-01", "ORG-02", "ORG-03", "EMAIL-02", "EMAIL-04", "EMAIL-06", "EMAIL-07", "EMAIL-09", "SEC-01"]),
]
INTERACTIONS_1_3 = [("IX-6", 15, None, ["ID-04"], None, ["SOC-09"])]
INTERACTIONS_1_4 = [
    ("DX-1", 15, "document-forgery", ["DOC-04"], ["transparent_overlay", "resolution_mismatch", "overlay"], FORGERY_WITH),
    ("DX-1", 15, "document-forgery", ["DOC-05", "DOC-08"], None, FORGERY_WITH),
    ("DX-1", 15, "document-forgery", ["DOC-02"], ["after_signature"], FORGERY_WITH),
]
INTERACTIONS_1_6 = [("DX-1", 15, "document-forgery", ["DOC-09"], ["high", "medium"], FORGERY_WITH)]
#: (id, level, all of these codes, any of these, claimed institution needed), in order.
FLOORS_1_0 = [
    ("FLOOR-REP05-MALICIOUS-URL", "high", ["REP-05"], None, False),
    ("FLOOR-REP04-KNOWN-TEMPLATE", "high", ["REP-04"], None, False),
    ("FLOOR-PAY03-SAFE-ACCOUNT", "high", ["PAY-03"], None, False),
    ("FLOOR-SEC01-INSTITUTION", "high", ["SEC-01"], None, True),
    ("FLOOR-SEC02-INSTITUTION", "high", ["SEC-02"], None, True),
    ("FLOOR-REP02-TECHNICAL", "critical", ["REP-02"], IMPERSONATION, False),
]
FLOORS_1_1 = [("FLOOR-EX2-EMAIL06-IDENTITY", "high", ["EMAIL-06"], ["EMAIL-01", "EMAIL-02", "EMAIL-04", "EMAIL-08", "EMAIL-09"], False)]
FLOORS_1_2 = [("FLOOR-ORG05-CONFIRMED", "high", ["ORG-05"], None, False)]
FLOORS_1_5 = [("FLOOR-URL10-CREDENTIAL-FORM", "high", ["URL-10"], None, True)]
FLOORS_1_6 = [("FLOOR-SOC10-MISTAKEN-PAYMENT", "high", ["SOC-10"], None, False)]
# End of the fixed values.

VERSIONS = ("rs-1.0", "rs-1.1", "rs-1.2", "rs-1.3", "rs-1.4", "rs-1.5", "rs-1.6")
ACTIVE = VERSIONS[-1]
_STEPS = {
    "rs-1.0": (WEIGHTS_1_0, HOST_CODES_1_0, [], INTERACTIONS_1_0, FLOORS_1_0),
    "rs-1.1": (WEIGHTS_1_1, HOST_CODES_1_1, ABSORB, INTERACTIONS_1_1, FLOORS_1_1),
    "rs-1.2": (WEIGHTS_1_2, HOST_CODES_1_2, [], INTERACTIONS_1_2, FLOORS_1_2),
    "rs-1.3": (WEIGHTS_1_3, [], [], INTERACTIONS_1_3, []),
    "rs-1.4": (WEIGHTS_1_4, [], [], INTERACTIONS_1_4, []),
    "rs-1.5": (WEIGHTS_1_5, [], [], [], FLOORS_1_5),
    "rs-1.6": (WEIGHTS_1_6, [], [], INTERACTIONS_1_6, FLOORS_1_6),
}


@dataclass
class Ruleset:
    """All rows of one version, in order."""

    version: str
    weights: dict = field(default_factory=dict)
    host_codes: list[str] = field(default_factory=list)
    absorb: list[tuple[str, str]] = field(default_factory=list)
    interactions: list[tuple] = field(default_factory=list)
    floors: list[tuple] = field(default_factory=list)

    @property
    def clamps_semantic(self) -> bool:
        """From rs-1.1 on, model evidence can't raise the level of a message that instructs checkers."""
        return self.version != VERSIONS[0]

    def weight_rows(self) -> list[tuple[str, str, int]]:
        """(code, key, points): key is v:<variant>, s:<source type> or d."""
        out = []
        for code, w in self.weights.items():
            for key, points in (w if isinstance(w, dict) else {"default": w}).items():
                out.append((code, "d" if key == "default" else f"{'s' if code in BY_SOURCE else 'v'}:{key}", points))
        return out

    def interaction_rows(self) -> list[tuple[int, str, int, str | None, str, str, str | None]]:
        """(ord, id, points, group, side, code, variant): one row a member."""
        out = []
        for k, (name, points, group, a, variants, b) in enumerate(self.interactions):
            out += [(k, name, points, group, "a", c, v) for c in a for v in variants or [None]]
            out += [(k, name, points, group, "b", c, None) for c in b]
        return out

    def floor_rows(self) -> list[tuple[int, str, int, int, str, str, int, bool]]:
        """(ord, id, level rank, band minimum, kind, code, number of required codes, institution needed)."""
        ranks = {level: (i, least) for i, (level, least) in enumerate(BANDS)}
        out = []
        for k, (name, level, every, some, claimed) in enumerate(self.floors):
            rank, least = ranks[level]
            out += [(k, name, rank, least, "all", c, len(every), claimed) for c in every]
            out += [(k, name, rank, least, "any", c, len(every), claimed) for c in some or []]
        return out

    def frames(self, spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Weights, interaction members and floor members as DataFrames; a few hundred rows."""
        return (
            spark.createDataFrame(self.weight_rows(), "w_code string, w_key string, w_points int"),
            spark.createDataFrame(self.interaction_rows(), "ix int, ix_id string, ix_points int, ix_group string, side string, ix_code string, ix_variant string"),
            spark.createDataFrame(self.floor_rows(), "fl int, fl_id string, fl_rank int, fl_min int, kind string, fl_code string, n_all int, needs_claim boolean"),
        )


def ruleset(version: str = ACTIVE) -> Ruleset:
    """The rows of a version: its ancestors' and its own. ValueError for an unknown one."""
    if version not in VERSIONS:
        raise ValueError(f"unknown ruleset {version}")
    out = Ruleset(version)
    for v in VERSIONS[: VERSIONS.index(version) + 1]:
        weights, hosts, absorb, interactions, floors = _STEPS[v]
        out.weights |= weights
        out.host_codes += hosts
        out.absorb += absorb
        out.interactions += interactions
        out.floors += floors
    return out
