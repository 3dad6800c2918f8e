"""Scoring queries over generated signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.plans import scoring
from tracewell.plans.ruleset import BANDS, CAP_LEXICON, CAP_SEMANTIC, IMPERSONATION, VERSIONS, ruleset
from tracewell.sources import messages as src


def risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(src.signals(spark, sf_dir), src.contexts(spark, sf_dir))


def risk_score_rs10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(src.signals(spark, sf_dir), src.contexts(spark, sf_dir), VERSIONS[0])


def risk_score_rs13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(src.signals(spark, sf_dir), src.contexts(spark, sf_dir), "rs-1.3")


def risk_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scoring.findings(scoring.members(src.signals(spark, sf_dir), ruleset()))
    return found.select("msg_id", "grp", "code", F.col("points").cast("long").alias("points"), F.col("n_members").cast("long").alias("n_members"), "sem", "lex", "det", F.array_join("codes", ",").alias("codes"))


def risk_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.trace(src.signals(spark, sf_dir), src.contexts(spark, sf_dir))


def risk_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = ruleset()
    m = scoring.members(src.signals(spark, sf_dir), rules)
    return scoring.interactions(m, scoring.findings(m), rules).groupBy("ix_id", "cls").agg(F.count("*").alias("messages"), F.sum("ix_points").cast("long").alias("points"))


def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = risk_score(spark, sf_dir)
    return s.agg(F.count("*").alias("total"), *[F.count_if(F.col("verdict") == v).alias(v) for v in ("scam", "suspicious", "safe")], F.count_if(F.col("verdict").isNull()).alias("unanalysed"))


def _values(rows: list[tuple], names: str) -> str:
    one = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows) + f") t({names})"


def _in(codes: list[str]) -> str:
    return "(" + ", ".join(f"'{c}'" for c in codes) + ")"


BASE = f"{src.SIGNALS_SQL}, {src.CONTEXTS_SQL}"


def ctes(version: str, base: str = BASE) -> str:
    """The same algorithm in SQL, for one version; ``base`` defines signals and contexts."""
    r = ruleset(version)
    moves, late = "grp", "0"
    for k, (into, taken) in enumerate(r.absorb):
        hit = f"grp = 'code:{taken}' AND has_{into.replace('-', '_')}"
        moves, late = f"CASE WHEN {hit} THEN 'code:{into}' ELSE {moves} END", f"CASE WHEN {hit} THEN {k + 1} ELSE {late} END"
    into = sorted({i for i, _ in r.absorb})
    has = "".join(f", bool_or(grp = 'code:{i}') OVER (PARTITION BY msg_id) AS has_{i.replace('-', '_')}" for i in into)
    some = [name for name, _, _, x, _ in r.floors if x] or ["-"]
    return f"""WITH {base},
 w AS (SELECT * FROM {_values(r.weight_rows(), 'code, k, p')}),
 ixm AS (SELECT * FROM {_values(r.interaction_rows(), 'ix, ix_id, ix_points, ix_group, side, code, variant')}),
 flm AS (SELECT * FROM {_values(r.floor_rows(), 'fl, fl_id, fl_rank, fl_min, kind, code, n_all, needs_claim')}),
 s0 AS (SELECT s.*, coalesce(wv.p, ws.p, wd.p, 0) AS points, CASE WHEN s.code IN {_in(r.host_codes)} AND s.host IS NOT NULL AND s.host <> '' THEN 'host:' || s.host ELSE 'code:' || s.code END AS grp
  FROM signals s LEFT JOIN w wv ON wv.code = s.code AND wv.k = 'v:' || s.variant LEFT JOIN w ws ON ws.code = s.code AND ws.k = 's:' || s.source_type LEFT JOIN w wd ON wd.code = s.code AND wd.k = 'd'),
 s1 AS (SELECT *{has} FROM s0),
 s2 AS (SELECT msg_id, ord, code, source_type, variant, host, points, {moves} AS grp, {late} AS late FROM s1),
 s3 AS (SELECT *, min(CASE WHEN late = 0 THEN ord END) OVER (PARTITION BY msg_id, grp) AS grp_ord FROM s2),
 imp AS (SELECT msg_id, arg_min(grp, grp_ord) AS host_grp FROM s3 WHERE code IN {_in(IMPERSONATION)} AND source_type <> 'semantic_model' GROUP BY msg_id),
 s4 AS (SELECT s3.msg_id, ord, code, source_type, variant, points, CASE WHEN grp = 'code:ID-04' AND host_grp IS NOT NULL THEN host_grp ELSE grp END AS grp, CASE WHEN grp = 'code:ID-04' AND host_grp IS NOT NULL THEN 99 ELSE late END AS late FROM s3 LEFT JOIN imp USING (msg_id)),
 mem AS (SELECT *, min(CASE WHEN late = 0 THEN ord END) OVER (PARTITION BY msg_id, grp) AS grp_ord, row_number() OVER (PARTITION BY msg_id, grp ORDER BY points + CASE WHEN source_type = 'semantic_model' THEN 0 ELSE 1000 END DESC, late, ord) AS place FROM s4),
 f AS (SELECT msg_id, grp, min(grp_ord) AS grp_ord, max(CASE WHEN place = 1 THEN code END) AS code, max(CASE WHEN place = 1 THEN points END) AS points, count(*) AS n_members,
  bool_and(source_type = 'semantic_model') AS sem, bool_and(source_type = 'lexicon') AS lex, bool_or(source_type IN ('rule', 'intel', 'community')) AS det, bool_or(source_type = 'lexicon') AS has_lex, bool_or(source_type = 'semantic_model') AS has_sem,
  array_to_string(list_sort(list_distinct(list(code))), ',') AS codes FROM mem GROUP BY msg_id, grp),
 hit AS (SELECT m.msg_id, ix, ix_id, ix_points, ix_group, m.grp, bool_or(side = 'a') AS in_a, bool_or(side = 'b') AS in_b, any_value(sem) AS sem, any_value(lex) AS lex
  FROM mem m JOIN f USING (msg_id, grp) JOIN ixm ON ixm.code = m.code AND (ixm.variant IS NULL OR ixm.variant = m.variant) GROUP BY ALL),
 both_ AS (SELECT msg_id, ix, ix_id, ix_points, ix_group, count(*) FILTER (WHERE in_a) AS n_a, count(*) FILTER (WHERE in_b AND NOT in_a) AS n_b, bool_and(sem) AS all_sem, bool_and(sem OR lex) AS all_lex FROM hit GROUP BY ALL),
 ixs AS (SELECT *, CASE WHEN all_sem THEN 'S' WHEN all_lex THEN 'L' ELSE 'O' END AS cls FROM (SELECT *, row_number() OVER (PARTITION BY msg_id, coalesce(ix_group, '#' || ix) ORDER BY ix) AS turn FROM both_ WHERE n_a > 0 AND n_b > 0) WHERE turn = 1),
 solid AS (SELECT DISTINCT m.msg_id, m.code FROM mem m JOIN f USING (msg_id, grp) WHERE NOT sem),
 fls AS (SELECT x.* FROM (SELECT msg_id, fl, fl_id, fl_rank, fl_min, n_all, needs_claim, count(*) FILTER (WHERE kind = 'all') AS n_hit, count(*) FILTER (WHERE kind = 'any') AS n_any FROM solid JOIN flm USING (code) GROUP BY ALL) x JOIN contexts USING (msg_id)
  WHERE n_hit = n_all AND (fl_id NOT IN {_in(some)} OR n_any > 0) AND (NOT needs_claim OR claimed))"""


def _rank(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {least} THEN {i}" for i, (_, least) in reversed(list(enumerate(BANDS)))) + " ELSE 0 END"


def score_sql(version: str, base: str = BASE) -> str:
    clamps = str(ruleset(version).clamps_semantic).lower()
    names = "['low', 'elevated', 'high', 'critical']"
    return f"""{ctes(version, base)},
 a AS (SELECT msg_id, sum(CASE WHEN sem THEN points ELSE 0 END) AS f_sem, sum(CASE WHEN NOT sem AND lex THEN points ELSE 0 END) AS f_lex, sum(CASE WHEN NOT sem AND NOT lex THEN points ELSE 0 END) AS f_other, count(*) AS n_findings, bool_or(NOT sem) AS solid,
  bool_or(list_contains(string_split(codes, ','), 'SOC-07')) AS soc07, sum(CASE WHEN sem AND code = 'SOC-07' THEN points ELSE 0 END) AS soc07_sem, bool_or(det) AS any_det, bool_or(det AND points >= 20) AS strong_det, bool_or(has_lex) AS any_lex, bool_or(has_sem) AS any_sem FROM f GROUP BY msg_id),
 b AS (SELECT msg_id, sum(CASE WHEN cls = 'S' THEN ix_points ELSE 0 END) AS ix_s, sum(CASE WHEN cls = 'L' THEN ix_points ELSE 0 END) AS ix_l, sum(CASE WHEN cls = 'O' THEN ix_points ELSE 0 END) AS ix_o, count(*) AS n_interactions FROM ixs GROUP BY msg_id),
 c AS (SELECT msg_id, max(fl_rank) AS floor_rank, max(fl_min) AS floor_min FROM fls GROUP BY msg_id),
 t0 AS (SELECT x.msg_id, semantic_ok, coalesce(n_findings, 0) AS n_findings, coalesce(n_interactions, 0) AS n_interactions, coalesce(solid, false) AS solid, coalesce(soc07, false) AS soc07, coalesce(soc07_sem, 0) AS soc07_sem,
  coalesce(any_det, false) AS any_det, coalesce(strong_det, false) AS strong_det, coalesce(any_lex, false) AS any_lex, coalesce(any_sem, false) AS any_sem, coalesce(floor_rank, -1) AS floor_rank, coalesce(floor_min, 0) AS floor_min,
  least({CAP_SEMANTIC}, coalesce(f_sem, 0) + coalesce(ix_s, 0)) AS ss, least({CAP_LEXICON}, coalesce(f_lex, 0) + coalesce(ix_l, 0)) AS ls, coalesce(f_other, 0) + coalesce(ix_o, 0) AS os
  FROM contexts x LEFT JOIN a USING (msg_id) LEFT JOIN b USING (msg_id) LEFT JOIN c USING (msg_id)),
 t1 AS (SELECT *, least(100, ss + ls + os) AS raw, least(100, ls + os + least(soc07_sem, ss)) AS backed FROM t0),
 t2 AS (SELECT *, {_rank('raw')} AS raw_rank, {_rank('backed')} AS backed_rank FROM t1),
 t3 AS (SELECT *, {clamps} AND soc07 AND ss > 0 AND raw_rank > backed_rank AS clamped FROM t2),
 t4 AS (SELECT *, CASE WHEN clamped THEN [20, 45, 70, 101][backed_rank + 1] - 1 ELSE raw END AS total0, CASE WHEN clamped THEN backed_rank ELSE raw_rank END AS rank0 FROM t3),
 t5 AS (SELECT *, floor_rank > rank0 AS floored, CASE WHEN floor_rank > rank0 THEN floor_min ELSE total0 END AS total, CASE WHEN floor_rank > rank0 THEN floor_rank ELSE rank0 END AS rk FROM t4)
SELECT msg_id, CAST(total AS BIGINT) AS score, {names}[rk + 1] AS level, CASE rk WHEN 0 THEN 'safe' WHEN 1 THEN 'suspicious' ELSE 'scam' END AS verdict,
 CASE WHEN strong_det OR (any_det AND CAST(any_lex AS INT) + CAST(any_sem AS INT) + CAST(any_det AS INT) >= 2) THEN 'high' WHEN any_det OR (any_lex AND any_sem) THEN 'moderate' WHEN any_lex THEN CASE WHEN semantic_ok THEN 'moderate' ELSE 'low' END WHEN any_sem THEN 'low' ELSE CASE WHEN semantic_ok THEN 'moderate' ELSE 'low' END END AS confidence,
 CASE WHEN rk = 0 THEN 'proceed' WHEN rk = 1 OR NOT solid THEN 'verify_first' ELSE 'do_not_pay' END AS decision, CAST(n_findings AS BIGINT) AS n_findings, CAST(n_interactions AS BIGINT) AS n_interactions, clamped, floored FROM t5"""


_ACTIVE = VERSIONS[-1]
QUERIES = {
    "risk_score": risk_score,
    "risk_score_rs10": risk_score_rs10,
    "risk_score_rs13": risk_score_rs13,
    "risk_findings": risk_findings,
    "risk_trace": risk_trace,
    "risk_interactions": risk_interactions,
    "verdict_counts": verdict_counts,
}
ORACLE = {
    "risk_score": score_sql(_ACTIVE),
    "risk_score_rs10": score_sql(VERSIONS[0]),
    "risk_score_rs13": score_sql("rs-1.3"),
    "risk_findings": f"{ctes(_ACTIVE)} SELECT msg_id, grp, code, CAST(points AS BIGINT) AS points, n_members, sem, lex, det, codes FROM f",
    "risk_interactions": f"{ctes(_ACTIVE)} SELECT ix_id, cls, count(*) AS messages, CAST(sum(ix_points) AS BIGINT) AS points FROM ixs GROUP BY ix_id, cls",
    "risk_trace": f"""{ctes(_ACTIVE)},
 up AS (SELECT * FROM (SELECT *, coalesce(max(fl_rank) OVER (PARTITION BY msg_id ORDER BY fl ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS top FROM fls) WHERE fl_rank > top),
 steps AS (SELECT msg_id, 1 AS stage, grp_ord AS pos, code AS id, points FROM f WHERE points > 0 UNION ALL SELECT msg_id, 2, ix, ix_id, ix_points FROM ixs UNION ALL SELECT msg_id, 3, fl, fl_id, fl_min FROM up)
 SELECT msg_id, row_number() OVER (PARTITION BY msg_id ORDER BY stage, pos, id) AS step, id, CAST(points AS BIGINT) AS points FROM steps""",
    "verdict_counts": f"SELECT count(*) AS total, count(*) FILTER (WHERE verdict = 'scam') AS scam, count(*) FILTER (WHERE verdict = 'suspicious') AS suspicious, count(*) FILTER (WHERE verdict = 'safe') AS safe, count(*) FILTER (WHERE verdict IS NULL) AS unanalysed FROM ({score_sql(_ACTIVE)})",
}
