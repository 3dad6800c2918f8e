"""A second reading of messages with respelled words unified, and quotes found in what was written.

The rewritten text serves matching only. Links, amounts, numbers and other
entities are never touched, and every part knows its place in the original.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import text as t
from tracewell.operators import offsets

# Results depend on them.
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
_MONEY = r"(?:Rs\.?|MUR|USD|EUR|GBP|€|\$|£)"
_AMOUNT = r"(?:\d{1,3}(?:[ ,.\x{a0}\x{202f}]\d{3})+(?:[.,]\d{1,2})?|\d+(?:[.,]\d{1,2})?)"
#: What a message is about, by kind; earlier kinds claim their place first.
ENTITIES = [
    ("priv", r"<PRIV_\d+>"),
    ("url", rf"(?iu){EDGE}(?:https?://|www\.)[^\s<>\"'`]+[^\s<>\"'`.,;:!?)\]]"),
    ("email", rf"(?iu){EDGE}[\p{{L}}\p{{N}}._%+-]+@[\p{{L}}\p{{N}}.-]+\.\p{{L}}{{2,}}{EDGE}"),
    ("amount", rf"(?iu)(?<![\p{{L}}\p{{N}}]){_MONEY}\s?{_AMOUNT}(?![\p{{L}}\p{{N}}])|(?<![\p{{L}}\p{{N}}.,]){_AMOUNT}\s?(?:Rs|MUR|USD|EUR|€)(?![\p{{L}}\p{{N}}])"),
    ("date", r"(?u)(?<!\p{N})(?:\d{4}-\d{2}-\d{2}|\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4})(?!\p{N})"),
    ("domain", r"(?iu)(?<![\p{L}\p{N}@.-])(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+(?:[a-z]{2,24})(?![\p{L}\p{N}-])(?:/[^\s<>\"'`]*[^\s<>\"'`.,;:!?)\]])?"),
    ("username", r"(?u)(?<![\p{L}\p{N}_])@[A-Za-z0-9_.]{3,30}"),
    ("phone", r"(?u)(?<!\p{N})\+?\d{2,3}[ -]?\d{3,4}[ -]?\d{4}(?!\p{N})"),
    ("number", r"(?u)(?<![\p{L}\p{N}])\d(?:[ -]?\d){3,}(?![\p{L}\p{N}])"),
]
NO_DOMAIN = r"(?i)^(?:e\.g|i\.e|a\.m|p\.m|etc)\.?$"
#: Words of one language only, and words that count half. Order and spelling as they must be.
MFE = """pou pu pe pann zame zamai finn inn fin ena pena bizin kapav zordi aster asterla deswit touswit
 lor enn bann dimounn dimoun mwa twa mo nou nu zot bloke sispann nimero telefonn mesaz kont modpas labank lakaz
 avoy avoye reavoy partaz konfirm konfirme verifye klik pey peye gagn gagne resevwar atann mersi bonzour
 sinon avek depi kot kouma ankor seki kifer devan larzan lekip sekirite peyman transaksion demann reponn
 personn okenn eskrok fer ferm debloke reveni ale vini zour minit erdtan avan minwi repons pa kod""".split()
MFE_HALF = "ou u sa li ek ar dan si ki".split()
EN = """the your you is are was were this that will please and with of for be been has have had not do does don't
 it we our me my send verify account payment click link details received receive debited credited claim share
 check reminder thanks thank hello dear customer security blocked suspended message phone pay free prize now
 today immediately anyone call tomorrow help just if by from at as or its them they their us password reply""".split()
EN_HALF = "bank urgent number confirm".split()
FR = """vous votre vos est sont les des une pour avec dans sur nous merci veuillez cette ces pas je il elle ce du au aux
 que qui mot passe vérification verification envoyez communiquez jamais personne bonjour conseiller carte
 paiement reçu recu informons sécurité securite appelle demain aide ici bientôt bientot habituelle toute question
 contactez agence confirmer bloquée bloquee suspendu suspendue cher chère cordialement""".split()
FR_HALF = "de le banque client compte code".split()
FR_ACCENT = "[éèêëàâçùûôîï]"
#: Least weight of a language beside the first.
SECOND_LANGUAGE = 1.5
CONTRACTION = r"(?iu)^(ou|mo|to|li|nou|nu|zot)['’]nn?$"
PERFECTIVE = ["inn", "in", "fin", "ine"]
PRONOUNS = ["ou", "u", "to", "mo", "li", "nou", "nu", "zot"]
# End of the fixed values.

_WORD = r"[\p{L}\p{M}][\p{L}\p{M}'’]*"
_UPPER_MARKS = ("ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ", "AAAAAACEEEEIIIINOOOOOUUUUY")


@dataclass(frozen=True)
class Variant:
    """A respelling: ``safe`` ones are unified anywhere, ``ambiguous`` ones in texts that this language leads, others never."""

    variant: str
    canonical: str
    safety: str = "ambiguous"


#: Respellings that are known without a resource.
VARIANTS = [Variant("nu", "nou"), Variant("pu", "pou"), Variant("u", "ou")]


def variant_table(rows: DataFrame) -> list[Variant]:
    """The respellings of a resource (canonical, variant, kind, safety): alternative spellings only; one with two canonical forms is left out. A dictionary, small enough to be a parameter."""
    one = rows.where("kind = 'alternative_spelling'").groupBy("variant").agg(F.count_distinct("canonical").alias("n"), F.min("canonical").alias("canonical"), F.min("safety").alias("safety")).where("n = 1")
    return [Variant(r["variant"], r["canonical"], r["safety"]) for r in one.orderBy("variant").collect()]


def entities(text: Column) -> Column:
    """(start, end, found, kind) of entities, in order of place: kinds claim their matches one after another, and a match that meets a claimed one goes."""
    kind_of = "array<struct<start:int,end:int,found:string,kind:string>>"
    groups = []
    for kind, pattern in ENTITIES:
        found = offsets.spans(text, pattern)
        if kind == "domain":
            found = F.filter(found, lambda m: ~F.rlike(m["found"], F.lit(NO_DOMAIN)))
        groups.append(_of_kind(found, kind))
    free = lambda claimed, m: ~F.exists(claimed, lambda c: offsets.overlaps(c, m))
    return F.array_sort(F.aggregate(F.array(*groups), F.array().cast(kind_of), lambda claimed, found: F.concat(claimed, F.filter(found, lambda m: free(claimed, m)))))


def _of_kind(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["found"].alias("found"), F.lit(kind).alias("kind")))


def without(text: Column, spots: Column) -> Column:
    """The text with a blank in place of each of the ordered ``spots``."""
    starts = F.concat(F.array(F.lit(0)), F.transform(spots, lambda s: s["end"]))
    ends = F.concat(F.transform(spots, lambda s: s["start"]), F.array(F.length(text)))
    return F.array_join(F.zip_with(starts, ends, lambda a, b: F.substr(text, a + 1, b - a)), " ")


def language_scores(text: Column) -> Column:
    """(mfe, en, fr, strong): weights of the words of three languages, and the number of words of the first that are no other's. ``text`` has no entities."""
    words = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{M}][\p{L}\p{M}'’-]*"), F.lit(0)), lambda w: F.regexp_replace(w, r"^['’-]+|['’-]+$", ""))
    one = lambda c, x: F.when(c, x).otherwise(0.0)

    def step(a: Column, w: Column) -> Column:
        strong = w.isin(MFE)
        en = F.when(w.isin(EN), 1.0).when(w.isin(EN_HALF), 0.5).otherwise(0.0)
        fr = F.when(w.isin(FR), 1.0).when(w.isin(FR_HALF), 0.5).otherwise(0.0) + one(F.rlike(w, F.lit(FR_ACCENT)), 0.5)
        return F.struct((a["mfe"] + F.when(strong, 1.0).when(w.isin(MFE_HALF), 0.5).otherwise(0.0)).alias("mfe"), (a["en"] + F.when(strong, 0.0).otherwise(en)).alias("en"), (a["fr"] + F.when(strong, 0.0).otherwise(fr)).alias("fr"), (a["strong"] + F.when(strong, 1).otherwise(0)).alias("strong"))

    return F.aggregate(F.filter(words, lambda w: w != ""), F.struct(F.lit(0.0).alias("mfe"), F.lit(0.0).alias("en"), F.lit(0.0).alias("fr"), F.lit(0).alias("strong")), step)


def language_mix(scores: Column) -> Column:
    """(primary, languages, mixed) of language_scores: the heaviest language first, others from SECOND_LANGUAGE on; 'en' and none where nothing was found."""
    rows = F.array(*[F.struct((-scores[c]).alias("w"), F.lit(k).alias("k"), F.lit(c).alias("lang")) for k, c in enumerate(("mfe", "en", "fr"))])
    ranked = F.array_sort(rows)
    top = F.get(ranked, F.lit(0))
    langs = F.transform(F.filter(ranked, lambda r: (r["lang"] == top["lang"]) | (r["w"] <= -SECOND_LANGUAGE)), lambda r: r["lang"])
    none = top["w"] == 0
    return F.struct(F.when(none, "en").otherwise(top["lang"]).alias("primary"), F.when(none, F.array().cast("array<string>")).otherwise(langs).alias("languages"), (~none & (F.size(langs) > 1)).alias("mixed"))


def _cased(was: Column, now: Column) -> Column:
    """``now`` in the case of ``was``: all capitals, a capital first, or as it is."""
    head = F.left(was, F.lit(1))
    return F.when((F.length(was) > 1) & (was == F.upper(was)), F.upper(now)).when(head != F.lower(head), F.concat(F.upper(F.left(now, F.lit(1))), F.substr(now, F.lit(2)))).otherwise(now)


def respelled(texts: DataFrame, variants: list[Variant] = VARIANTS) -> DataFrame:
    """Adds normal (the rewritten text), segments (its offset map) and changed to ``texts`` (column text).

    Work is per row, so give distinct texts. Null counts as empty. Latin
    diacritics only are taken off words; other scripts stay.
    """
    d = offsets.computed(texts.withColumn("_t", F.coalesce("text", F.lit(""))), _spots=entities(F.col("_t")), _words=offsets.spans(F.col("_t"), _WORD))
    d = offsets.computed(d, _mix=language_scores(without(F.col("_t"), F.col("_spots"))))
    present = F.col("_mix.strong") >= 2
    leads = present & (F.col("_mix.mfe") >= F.col("_mix.en")) & (F.col("_mix.mfe") >= F.col("_mix.fr"))
    d = offsets.computed(d, _present=present, _leads=leads)
    table = F.create_map(*[F.lit(x) for v in variants if v.safety in ("safe", "ambiguous") for x in (v.variant, v.canonical)]) if variants else None
    safe = [v.variant for v in variants if v.safety == "safe"]

    def now(w: Column, k: Column) -> Column:
        word, lower = w["found"], F.lower(w["found"])
        before = F.get(F.col("_words"), k - 1)
        gap = F.substr(F.col("_t"), before["end"] + 1, w["start"] - before["end"])
        perfective = (k > 0) & lower.isin(PERFECTIVE) & F.lower(before["found"]).isin(PRONOUNS) & F.rlike(gap, F.lit(r"^\s+$"))
        plain = F.translate(F.translate(word, *t.LATIN_MARKS), *_UPPER_MARKS)
        out = F.when(F.rlike(word, F.lit(CONTRACTION)), F.concat(F.regexp_extract(word, CONTRACTION, 1), F.lit(" finn"))).when(perfective, _cased(word, F.lit("finn")))
        if table is not None:
            out = out.when(table[lower].isNotNull() & (lower.isin(safe) | F.col("_leads")), _cased(word, table[lower]))
        out = out.when(F.col("_present"), plain).otherwise(word)
        return F.when(F.exists(F.col("_spots"), lambda s: offsets.overlaps(s, w)), word).otherwise(out)

    words = F.col("_words")
    d = offsets.computed(d, _now=F.transform(words, now))
    starts = F.concat(F.array(F.lit(0)), F.transform(words, lambda w: w["end"]))
    ends = F.concat(F.transform(words, lambda w: w["start"]), F.array(F.length("_t")))
    gaps = F.zip_with(starts, ends, lambda a, b: F.substr(F.col("_t"), a + 1, b - a))
    run = lambda was, new: F.struct(was.alias("was"), new.alias("now"), (was != new).alias("replaced"))
    own = F.zip_with(F.transform(words, lambda w: w["found"]), F.col("_now"), run)
    # Gaps and words take turns; the gap after the last word stands alone.
    pairs = F.zip_with(F.slice(F.col("_gaps"), F.lit(1), F.size(words)), own, lambda g, r: F.array(run(g, g), r))
    last = F.element_at(F.col("_gaps"), -1)
    d = offsets.computed(d, _gaps=gaps)
    d = offsets.computed(d, _runs=F.concat(F.flatten(pairs), F.array(run(last, last))))
    d = offsets.computed(d, normal=offsets.rewritten(F.col("_runs")), segments=offsets.from_runs(F.col("_runs")))
    return d.withColumn("changed", F.col("normal") != F.col("_t")).select(*texts.columns, "normal", "segments", "changed")


def fold_runs(text: Column) -> Column:
    """Runs of a text for matching only: lower case, plain quotes, white space as one blank."""
    plain = F.translate(F.lower(text), "‘’‛`´“”«»", "'''''\"\"\"\"")
    # Lower case and quotes keep the length, so words of both texts stand side by side.
    was, new = F.regexp_extract_all(text, F.lit(r"\s+|\S+"), F.lit(0)), F.regexp_extract_all(plain, F.lit(r"\s+|\S+"), F.lit(0))
    blank = lambda x: F.rlike(x, F.lit(r"^\s"))
    return F.zip_with(was, new, lambda a, b: F.struct(a.alias("was"), F.when(blank(a), " ").otherwise(b).alias("now"), blank(a).alias("replaced")))


def located(rows: DataFrame) -> DataFrame:
    """Adds spot (start, end) and quote: where ``evidence`` stands in ``text``, null if it doesn't.

    As it is, else with case, quotes and white space folded; the quote is cut
    from the text, so it is what was written. Evidence of fewer than three
    characters is nowhere.
    """
    needle = t.normalised(F.col("evidence"))
    text = F.coalesce("text", F.lit(""))
    d = offsets.computed(rows, _at=F.call_function("position", needle, text))
    d = offsets.computed(d, _runs=F.when((F.col("_at") == 0) & (F.length(needle) >= 3), fold_runs(text)))
    d = offsets.computed(d, _folded=F.call_function("position", t.folded(needle), offsets.rewritten(F.col("_runs"))), _map=offsets.from_runs(F.col("_runs")))
    mapped = offsets.to_original(F.col("_map"), F.col("_folded") - 1, F.col("_folded") - 1 + F.length(t.folded(needle)), F.length(text))
    direct = F.struct((F.col("_at") - 1).cast("int").alias("start"), (F.col("_at") - 1 + F.length(needle)).cast("int").alias("end"))
    d = d.withColumn("spot", F.when(F.col("evidence").isNull() | (F.length(needle) < 3), None).when(F.col("_at") > 0, direct).when(F.col("_folded") > 0, mapped))
    return d.withColumn("quote", F.substr(text, F.col("spot.start") + 1, F.col("spot.end") - F.col("spot.start"))).drop("_at", "_runs", "_folded", "_map")
