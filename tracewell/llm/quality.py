"""Quality rules: text statistics and a decision list learned from labels.

Everything here is DataFrame work: statistics are built-in expressions, rule
learning is a few small aggregations over labelled statistics, and the
learned list is one CASE expression.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import SPACE, table, trimmed, words, written

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: What rules may test: a name and its SQL over the statistics.
FEATURES = {
    "n_words": "double(n_words)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "distinct": "n_distinct_words / greatest(n_words, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
}


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``n_words``, ``word_chars``, ``n_symbols``, ``n_lines``, ``n_dup_lines``, ``n_repeat_words``, ``n_distinct_words``, ``n_digits`` of whole texts.

    Windows of eight words are compared by 64-bit hash within their text. A
    text without a repeated window, the usual case, is done once its distinct
    hashes are counted; else hashes are sorted with their positions, equal
    neighbours are repeats, and the words they cover are counted from the
    sorted positions. So work is n log n in a text's words. Null and blank
    texts count 0 everywhere.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("id"), text.alias("txt"), words(F.col(text_col)).alias("w"), F.filter(F.split(text, "\n"), lambda x: trimmed(x) != "").alias("lines"))
    d = d.select(
        "id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("txt", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("txt") - F.length(F.translate("txt", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct_words"),
        (F.length("txt") - F.length(F.translate("txt", "0123456789", ""))).cast("long").alias("n_digits"),
        F.expr(f"IF(size(w) >= {WINDOW}, transform(sequence(1, size(w) - {WINDOW - 1}), i -> xxhash64(slice(w, i, {WINDOW}))), array())").alias("grams"),
    )
    d = d.withColumn("by_hash", F.expr("IF(size(array_distinct(grams)) < size(grams), sort_array(transform(grams, (h, i) -> struct(h, i))), array())"))
    d = d.withColumn("starts", F.expr("sort_array(transform(filter(by_hash, (x, i) -> get(by_hash, i - 1).h <=> x.h OR get(by_hash, i + 1).h <=> x.h), x -> x.i))"))
    covered = f"aggregate(starts, struct(0L AS n, {-WINDOW} AS last), (s, p) -> struct(s.n + least({WINDOW}, p - s.last) AS n, p AS last), s -> s.n)"
    return d.withColumn("n_repeat_words", F.expr(covered)).drop("grams", "by_hash", "starts")


@dataclass
class Rule:
    """Reject where all conditions hold: (feature, '<=' or '>', threshold)."""

    conditions: list[tuple[str, str, float]] = field(default_factory=list)

    def sql(self) -> str:
        return " AND ".join(f"({FEATURES[f]}) {op} {t!r}D" for f, op, t in self.conditions) or "true"


def _cut_counts(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[tuple[str, int], tuple[int, int]]:
    """(feature, bin) -> (bad, good) rows; one small aggregation."""
    bins = [F.expr(f"struct('{f}' AS f, size(filter(array({', '.join(f'{c!r}D' for c in cs)}), c -> c < x_{f})) AS b)") for f, cs in cuts.items() if cs]
    got = rows.select("bad", F.explode(F.array(*bins)).alias("z")).groupBy("z.f", "z.b").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n"))
    return {(r["f"], r["b"]): (r["p"], r["n"]) for r in got.collect()}


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    """FOIL's information gain of going from (p0, n0) to (p, n)."""
    from math import log2

    return p * (log2(p / (p + n)) - log2(p0 / (p0 + n0))) if p else 0.0


def learn_rules(labelled: DataFrame, max_rules: int = 6, max_conditions: int = 3, min_precision: float = 0.9, min_support: int = 10, n_cuts: int = 31) -> list[Rule]:
    """An ordered list of rejecting rules, by sequential covering.

    ``labelled`` has statistics(), ``id`` and ``bad`` (1: reject, 0: keep).
    Two thirds of the rows, by hash of the id, grow a rule: the condition with
    the largest information gain is added until no good row is left or
    nothing gains. The last third prunes it: trailing conditions go where
    (bad - good) / (bad + good) is no worse without them. A rule stays if it
    has ``min_precision`` on either part and ``min_support`` bad rows; rows
    that it covers are left out for the next. Thresholds are quantiles. Only
    histograms of features x ``n_cuts`` bins reach the driver. Without
    labelled rows of both kinds the list is empty.
    """
    rows = labelled.select("id", F.col("bad").cast("int").alias("bad"), *labelled.columns[1 : labelled.columns.index("bad")], *[F.expr(sql).alias(f"x_{f}") for f, sql in FEATURES.items()], (F.pmod(F.xxhash64("id"), F.lit(3)) == 0).alias("held"))
    rows = written(rows, "quality-labelled")
    probs = [(i + 1) / (n_cuts + 1) for i in range(n_cuts)]
    q = rows.agg(*[F.percentile_approx(f"x_{f}", probs, 10_000).alias(f) for f in FEATURES]).first()
    cuts = {f: sorted(set(q[f] or [])) for f in FEATURES}
    out: list[Rule] = []
    while len(out) < max_rules:
        open_ = rows
        for r in out:
            open_ = open_.where(f"NOT ({r.sql()})")
        rule, grow = Rule(), open_.where("NOT held")
        base = grow.agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).first()
        p0, n0 = base["p"] or 0, base["n"] or 0
        if p0 < min_support or not n0:
            break
        while len(rule.conditions) < max_conditions and n0:
            counts = _cut_counts(grow.where(rule.sql()), cuts)
            best = (1e-9, None, 0, 0)
            for f, cs in cuts.items():
                p = n = 0
                for b, c in enumerate(cs):
                    dp, dn = counts.get((f, b), (0, 0))
                    p, n = p + dp, n + dn
                    for op, pp, nn in (("<=", p, n), (">", p0 - p, n0 - n)):
                        if pp >= min_support and (g := _gain(pp, nn, p0, n0)) > best[0]:
                            best = (g, (f, op, c), pp, nn)
            if best[1] is None:
                break
            rule.conditions.append(best[1])
            p0, n0 = best[2], best[3]
        if not rule.conditions:
            break
        prefixes = [Rule(rule.conditions[: k + 1]) for k in range(len(rule.conditions))]
        sums = [F.sum(F.when(F.expr(x.sql()) & (F.col("bad") == b) & (F.col("held") == h), 1).otherwise(0)).alias(f"s{k}_{b}_{int(h)}") for k, x in enumerate(prefixes) for b in (1, 0) for h in (True, False)]
        s = open_.agg(*sums).first()
        worth = lambda k: (s[f"s{k}_1_1"] - s[f"s{k}_0_1"]) / max(1, s[f"s{k}_1_1"] + s[f"s{k}_0_1"])
        k = max(range(len(prefixes)), key=lambda k: (worth(k), -k))
        sure = all(s[f"s{k}_1_{h}"] >= min_precision * (s[f"s{k}_1_{h}"] + s[f"s{k}_0_{h}"]) for h in (0, 1))
        if not sure or s[f"s{k}_1_0"] < min_support or not s[f"s{k}_1_1"]:
            break
        out.append(prefixes[k])
    return out


def rule_column(rules: list[Rule]) -> Column:
    """Number of the first rule that rejects, 0 if none does: one ordered CASE expression."""
    if not rules:
        return F.lit(0)
    return F.expr("CASE " + " ".join(f"WHEN {r.sql()} THEN {i + 1}" for i, r in enumerate(rules)) + " ELSE 0 END")


def labelled_statistics(stats: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """Statistics of labelled rows with ``bad``; about ``max_rows`` of them, chosen by hash of the id.

    ``labels`` has doc_id and quality; repeated labels of an id count once,
    by the lowest quality; null labels and ids are left out.
    """
    one = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = one.count()
    if n > max_rows:
        one = one.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("rules")), F.lit(1_000_000)) < int(1e6 * max_rows / n))
    return stats.join(one, stats["id"] == one["doc_id"]).select(*stats.columns, F.when(F.col("quality") == 0, 1).otherwise(0).alias("bad"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 20_000) -> DataFrame:
    """Statistics of every row with ``base_failed``, ``rule`` and ``kept``.

    base_failed: fewer than 20 words, or more than 30 % of them in repeated
    windows. ``rule`` is the learned rule that rejects (0: none); of rules
    that fit one row the first in their order counts. Rows with repeated or
    null ids are judged one by one like any other; null texts have no words;
    texts are read whole, however long; an empty table gives no row; columns
    other than id and text are not read, so their names don't matter.
    """
    stats = written(statistics(docs, id_col, text_col), "quality-stats")
    rules = learn_rules(labelled_statistics(stats, labels, max_rows))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = stats.withColumn("base_failed", failed).withColumn("rule", rule_column(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)).withColumnRenamed("id", id_col)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
