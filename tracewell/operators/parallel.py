"""Pairs of texts that should say the same: what kind of pair a line is, and what is wrong with a translation.

Everything is a column expression over the row, so a corpus of pairs is one
scan without a shuffle. Null sides count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators import offsets, spelling

# Results depend on them.
WORD = r"[\p{L}\p{N}_'-]+"
#: A longer side of so many words may have three times the words of the other at most.
RATIO_WORDS, MOST_RATIO = 6, 3
#: Words by which a text of each language denies something; ``EDGE`` stands where a word ends.
NEGATION = {"mfe": "EDGE(?:pa|pann|zame|zamai|pena)EDGE", "en": "EDGE(?:not|never|no|nobody|neither|without|cannot)EDGE|n['’]tEDGE", "fr": "EDGE(?:ne|n['’]|pas|jamais|personne|sans|aucun|aucune)EDGE"}
#: The letters that these words begin with.
DENIAL_STARTS = {"mfe": "pz", "en": "ncw", "fr": "npjsa"}
PLACEHOLDER = r"<[A-Z]+_[0-9]+>"
STRAY_MARKUP = r"</?[A-Za-z][^<>]{0,40}>"
NONSTANDARD = r"(?iu)(?<![\p{L}\p{N}'’])(?:u|nu|pu)(?![\p{L}\p{N}'’])"
MOST_LENGTH, MORE_LENGTH = 4, 40
SHORT_WORDS, LEAST_WORDS = 6, 0.3
COPIED_WORDS, LANGUAGE_WORDS = 4, 4
# End of the fixed values.

_TEXT_WORD = r"[\p{L}\p{N}]+"
_BLANK = r"[\t-\r ]+"


def _trimmed(text: Column) -> Column:
    """Without blanks at its ends; a pattern would try each run of blanks anew from each of its places."""
    return F.btrim(text, F.lit("\t\n\v\f\r "))


def _has(text: Column, pattern: str) -> Column:
    return F.rlike(text, F.lit(pattern))


def classified(pairs: DataFrame) -> DataFrame:
    """Adds pair_class and flags (array) to rows with ``source`` and ``target``.

    The first that applies: invalid (a side is empty, has no letter, or holds
    the replacement character), suspected_misalignment (equal sides of more
    than three words, lengths too far apart, no words beside four or more),
    single_word_gloss, dictionary_definition, short_phrase, natural_sentence.
    """
    d = offsets.computed(pairs, _s=_trimmed(F.coalesce("source", F.lit(""))), _t=_trimmed(F.coalesce("target", F.lit(""))))
    d = offsets.computed(d, _sw=F.regexp_count("_s", F.lit(WORD)), _tw=F.regexp_count("_t", F.lit(WORD)))
    s, t, sw, tw = (F.col(c) for c in ("_s", "_t", "_sw", "_tw"))
    lo, hi = F.least(sw, tw), F.greatest(sw, tw)
    folded = lambda x: F.regexp_replace(F.lower(x), _BLANK, " ")
    why = F.when((s == "") | (t == ""), "empty_side").when(~_has(s, r"\p{L}") | ~_has(t, r"\p{L}"), "no_letters").when(F.contains(s, F.lit("�")) | F.contains(t, F.lit("�")), "replacement_char")
    odd = F.array_compact(F.array(
        F.when((folded(s) == folded(t)) & (sw > 3), "source_equals_target"), F.when((hi >= RATIO_WORDS) & (lo > 0) & (hi > MOST_RATIO * lo), "length_ratio_gt_3"), F.when((hi >= 4) & (lo == 0), "empty_words"),
    ))
    d = offsets.computed(d, _why=why, _odd=odd)
    kind = F.when(F.col("_why").isNotNull(), "invalid").when(F.size("_odd") > 0, "suspected_misalignment").when((sw == 1) & (tw == 1), "single_word_gloss").when((lo <= 2) & (hi >= 6), "dictionary_definition")
    kind = kind.when((hi <= 2) & (lo == 1), "single_word_gloss").when(hi <= 4, "short_phrase").otherwise("natural_sentence")
    return d.withColumn("pair_class", kind).withColumn("flags", F.when(F.col("_why").isNotNull(), F.array("_why")).otherwise(F.col("_odd"))).select(*pairs.columns, "pair_class", "flags")


def _denies(text: Column, language: str) -> Column:
    """Only places of a letter that such words begin with are tried; before a letter, an edge is where no word character stands."""
    words = NEGATION[language].replace("EDGE(?:", "(?<![A-Za-z0-9_])(?:").replace("EDGE", spelling.EDGE)
    first = f"[{DENIAL_STARTS[language]}]"
    return _has(text, f"(?i){first}(?<=(?={words}){first})")


def checked(rows: DataFrame, source: str, target: str, deep: bool = True) -> DataFrame:
    """Adds problems, an array of (kind, detail), to translations; an empty one means that it may be used.

    ``rows`` has text (entities as placeholders such as <URL_1>), output and
    placeholders (those of the text). In this order: empty_output alone; lost,
    duplicated and unknown placeholders; unsupported_entity; stray_markup;
    too_long; too_short; not_translated; negation_mismatch; number_mismatch;
    nonstandard_spelling; wrong_language. ``deep`` asks for the entities and
    the language of the output, too. Lengths are in code points.
    """
    marks = F.regexp_extract_all(F.col("_o"), F.lit(PLACEHOLDER), F.lit(0))
    bare = lambda c: F.regexp_replace(c, PLACEHOLDER, " ")
    d = offsets.computed(rows, _i=F.coalesce("text", F.lit("")), _o=F.coalesce("output", F.lit("")), _p=F.coalesce("placeholders", F.array().cast("array<string>")))
    d = offsets.computed(d, _m=marks, _ib=bare(F.col("_i")), _ob=bare(F.col("_o")))
    d = offsets.computed(d, _iw=F.regexp_count("_ib", F.lit(_TEXT_WORD)), _ow=F.regexp_count("_ob", F.lit(_TEXT_WORD)), _id=_digits("_ib"), _od=_digits("_ob"), _ni=_denies(F.col("_i"), source), _no=_denies(F.col("_o"), target))
    i, o, ib, ob, iw, ow = (F.col(c) for c in ("_i", "_o", "_ib", "_ob", "_iw", "_ow"))
    problem = lambda kind, detail: F.struct(F.lit(kind).alias("kind"), F.coalesce(detail, F.lit("")).alias("detail"))
    none = F.array().cast("array<struct<kind:string,detail:string>>")
    when = lambda test, kind, detail=F.lit(""): F.when(test, F.array(problem(kind, detail))).otherwise(none)
    times = lambda p: F.size(F.filter(F.col("_m"), lambda m: m == p))
    kept = F.filter(F.transform(F.col("_p"), lambda p: F.when(times(p) == 0, problem("lost", p)).when(times(p) > 1, problem("duplicated", p))), lambda x: x.isNotNull())
    parts = [kept, F.transform(F.array_except(F.col("_m"), F.col("_p")), lambda m: problem("unknown_placeholder", m))]
    if deep:
        d = offsets.computed(d, _e=spelling.entities(ob))
        d = offsets.computed(d, _scores=spelling.language_scores(spelling.without(ob, F.col("_e"))))
        d = offsets.computed(d, _mix=spelling.language_mix(F.col("_scores")))
        parts.append(F.transform(F.col("_e"), lambda e: problem("unsupported_entity", e["found"])))
    parts += [
        when(_has(ob, STRAY_MARKUP) & ~_has(ib, STRAY_MARKUP), "stray_markup"),
        when(F.length(o) > F.length(i) * MOST_LENGTH + MORE_LENGTH, "too_long"),
        when((iw >= SHORT_WORDS) & (ow < iw * F.lit(LEAST_WORDS)), "too_short"),
        when((iw >= COPIED_WORDS) & (F.lower(_trimmed(o)) == F.lower(_trimmed(i))), "not_translated"),
        when(F.col("_ni") != F.col("_no"), "negation_mismatch", F.when(F.col("_ni"), "lost").otherwise("added")),
        when(F.col("_id") != F.col("_od"), "number_mismatch"),
    ]
    if target == "mfe":
        parts.append(when(_has(ob, NONSTANDARD), "nonstandard_spelling"))
    if deep:
        fits = F.array_contains("_mix.languages", "mfe") & (F.col("_scores.mfe") >= spelling.SECOND_LANGUAGE) if target == "mfe" else F.col("_mix.primary") == target
        parts.append(when((ow >= LANGUAGE_WORDS) & ~fits, "wrong_language", F.col("_mix.primary")))
    # Who explodes them has a filter on their number: it must not hold all of this again.
    return offsets.computed(d, problems=F.when(_trimmed(o) == "", F.array(problem("empty_output", F.lit("")))).otherwise(F.concat(*parts))).select(*rows.columns, "problems")


def _digits(column: str) -> Column:
    """All runs of digits, in order of their spelling."""
    return F.array_join(F.array_sort(F.regexp_extract_all(F.col(column), F.lit("[0-9]+"), F.lit(0))), ",")
