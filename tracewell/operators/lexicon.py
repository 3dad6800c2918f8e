"""Phrase rules in three languages, with guards.

Each rule is a pattern; a match counts unless a guard of the rule explains it
away (a negation in its clause, a notice of something done, a bank's own
footer). The first surviving match of the first rule of a code is the code's
signal. All rules run on all messages, as expressions.
"""

from __future__ import annotations

import operator
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators import offsets, spelling
from tracewell.sources.scratch import written

# Which messages match depends on these patterns.
_NOUN = r"(?:otp|one[- ]time (?:password|pin|code)|(?:verification|security|confirmation|sms|\d[- ]digit|\d+[- ]chiffres?) code|code (?:de (?:v[ée]rification|s[ée]curit[ée])|re[çc]u|[àa] \d+ chiffres|pin)|code\b|pin(?: code)?\b|password|passcode|mot de passe|modpas|cvv|cvc|kod\b)"
_SHARE = r"(?:send|give|share|provide|confirm|reply(?: back)?(?: with)?|tell|read(?: (?:it|them))?(?: back)?|forward|text|verify|envoy(?:ez|er)|donn(?:ez|er)|communiqu(?:ez|er)|transmett(?:ez|re)|confirm(?:ez|er)|indiqu(?:ez|er)|partag(?:ez|er)|r[ée]pond(?:ez|re)(?: avec)?|renvoy(?:ez|er)|dites|avoy(?:e)?|donn|konfirm(?:e)?|dir|partaz|ekrir|reponn(?: avek)?|verifye)"
_GAP = r"(?:(?!\b(?:{0})\b)(?:[^.!?\n]|\.(?![\s]|$)|\n)){{0,100}}?"
#: (code, language, guards, pattern)
RULES = [
    ("SEC-01", "mixed", "negated inner", rf"\b{_SHARE}\b[^.!?\n]{{0,30}}?\b{_NOUN}"),
    ("SEC-01", "en", "negated", r"\bwhat (?:is|was) (?:the |your )?(?:otp|pin|password|code)\b"),
    ("SEC-03", "en", "wraps", r"\b(?:log|sign)(?:s|ged|ging|ed|ing)?[- ]?(?:in|into)\b" + _GAP.format(r"never|not|don'?t|do not|won'?t|will not|no one|nobody") + r"\b(?:password|passcode)\b"),
    ("SEC-03", "fr", "wraps", r"\b(?:connectez|identifiez)[- ]?vous\b" + _GAP.format("jamais|pas|ne") + r"\bmot de passe\b"),
    ("SEC-03", "mfe", "wraps", r"\bkonekte\b" + _GAP.format("pa|zame|zamai|pann") + r"\bmodpas\b"),
    ("SEC-02", "mixed", "", r"\b(?:anydesk|teamviewer|quick ?support|rustdesk|ultraviewer|remote (?:access|desktop|control|support) (?:app|application|software|tool)|screen[- ]?shar(?:e|ing) (?:app|application))\b"),
    ("PAY-03", "en", "", r"\b(?:safe|secure|safety|protected|holding) account\b|\b(?:move|transfer) (?:your |all your )?(?:money|funds|savings|balance) (?:to|into) (?:a |an )?(?:new|safe|secure|temporary|protected)\b"),
    ("PAY-03", "fr", "", r"\bcompte (?:s[ée]curis[ée]|s[ûu]r|de s[ée]curit[ée]|temporaire)\b"),
    ("PAY-03", "mfe", "", r"\bkont (?:sekirize|sekirite|provizwar)\b"),
    ("PAY-02", "mixed", "", r"\b(?:gift ?cards?|google play (?:cards?|vouchers?|gift ?cards?)|itunes (?:cards?|vouchers?)|steam cards?|amazon (?:gift )?cards?|bitcoin|btc|crypto(?:currency)?(?: wallet)?|usdt|binance|western union|moneygram|cash courier|cartes? cadeaux?|cryptomonnaie|kart kado)\b"),
    ("PAY-04", "en", "", r"\b(?:processing|release|clearance|customs|delivery|admin(?:istration)?|activation|registration|handling|verification|unlock(?:ing)?) fee\b|\bfee (?:to|before) (?:release|receive|claim|unlock)\b|\bstarter kit\b"),
    ("PAY-04", "fr", "", r"\bfrais (?:de |d')(?:dossier|douane|d[ée]douanement|livraison|d[ée]blocage|traitement|v[ée]rification|inscription)\b"),
    ("PAY-04", "mfe", "", r"\b(?:fre|frais) (?:douane|dwann|livrezon|livraison|inscription|lenskripsion|verification|verifikasion)\b|\b(?:fre|frais) (?:pou|pu) (?:debloke|libere|resevwar|reklam|aktive|reaktive|ranbours|delivre|retir)\b"),
    ("PAY-07", "en", "", r"\b(?:bank(?:ing)?|account|payment) details (?:have |has )?(?:changed|been (?:changed|updated))\b|\bnew (?:bank )?account (?:details|number)\b|\bupdated (?:bank|payment) details\b"),
    ("PAY-07", "fr", "", r"\bchangement de banque\b|\bnouveau compte\b|\bnouvelles coordonn[ée]es bancaires\b"),
    ("PAY-07", "mfe", "", r"\bdetail la banque inn sanze\b|\bnouvo (?:compte|kont)\b"),
    ("PAY-01", "en", "passive noun", r"\b(?:pay|send|transfer|deposit|remit|wire)\b[^.!?\n]{0,30}?(?:\brs\.?\s?\d|\bmur\s?\d|€\s?\d|\$\s?\d|\bmoney\b|\bfunds?\b|\bamount\b|\bfee\b)|\bmake (?:a|the) payment\b|\bpay (?:now|the (?:fee|amount))\b"),
    ("PAY-01", "fr", "", r"\b(?:payez|payer|r[ée]glez|r[ée]gler|envoyez|envoyer|m'envoyer|virez|versez|verser)\b[^.!?\n]{0,30}?(?:\brs\.?\s?\d|\bmur\b|€|\bargent\b|\bmontant\b|\bfrais\b)|\beffectuer le paiement\b|\bfaire un virement\b"),
    ("PAY-01", "mfe", "perfective", r"\b(?:pey|peye|avoy(?:e)?|reavoy+|envoye|fer (?:enn )?transfer|depoz(?:e)?|investi)\b[^.!?\n]{0,30}?(?:\brs\.?\s?\d|\blarzan\b|\bkas\b|\bfre\b|\bfrais\b)|\bavoy(?:e)? lor sa (?:numero|nimero)\b|\bbizin rs\.?\s?\d"),
    ("SOC-03", "en", "", r"\b(?:don'?t|do not|never) tell (?:anyone|anybody|your|dad|mum|mom)\b|\btell no ?one\b|\bkeep (?:this|it) (?:secret|confidential|between us|to yourself)\b|\bdon'?t (?:inform|contact|call) (?:your )?(?:bank|family|anyone)\b|\bbetween (?:you and me|us)\b"),
    ("SOC-03", "fr", "", r"\bn'en parle(?:z)? pas\b|\bne (?:le |la |les )?dites (?:rien )?[àa] personne\b|\bgardez (?:ça|cela|le|la) (?:secret|pour vous)\b"),
    ("SOC-03", "mfe", "", r"\bpa dir (?:personn|papa|mama|dimounn|okenn)\b|\bpa koz(?:e)? (?:ar|avek) personn\b|\bgard sa (?:sekre|pou twa)\b"),
    ("SOC-08", "en", "negated", r"\bbypass (?:the |our |your )?(?:normal |usual |standard )?(?:process|procedure|approvals?|controls?|checks?|sign[- ]?off)\b|\b(?:skip|without) (?:the |our )?(?:usual|normal|standard) (?:approvals?|process|procedure|checks?|sign[- ]?off|verification)\b|\bdon'?t (?:go through|involve|copy|cc|loop in) (?:finance|accounts|procurement|the (?:finance|accounts|procurement) team|anyone else)\b|\bno need to (?:verify|call|check|confirm)\b"),
    ("SOC-08", "fr", "negated", r"\bsans (?:passer par|la validation|l'approbation|validation)\b|\bcontourn(?:er|ez) (?:la |les )?(?:proc[ée]dure|validation|contr[ôo]les?)\b|\binutile de (?:v[ée]rifier|rappeler|confirmer)\b"),
    ("SOC-08", "mfe", "", r"\bpa bizin (?:verifye|konfirme|apel|telefonn)\b|\bpa pas par (?:finans|kontabilite|lakontabilite)\b"),
    ("SOC-02", "en", "", r"\bsuspend(?:ed|sion)?\b|\b(?:will be|has been|be) (?:blocked|locked|frozen|closed|deactivated|terminated|restricted)\b|\blegal action\b|\bprosecut(?:ion|ed)\b|\barrest(?:ed)?\b|\bpenalt(?:y|ies)\b|\bbe fined\b|\bpermanent(?:ly)? (?:lock|block|closure|freeze)\b|\blose access\b"),
    ("SOC-02", "fr", "", r"\bsuspendu(?:e)?\b|\bbloqu[ée](?:e)?\b|\bgel[ée]\b|\bd[ée]sactiv[ée]\b|\bpoursuites\b|\bp[ée]nalit[ée]\b|\bamende\b"),
    ("SOC-02", "mfe", "", r"\bbloke\b|\b(?:inn|finn|in|pe|pou|ti)\s+(?:sispann|sispandi)\b|\b(?:kont|kart|servis|akse)\b[^.!?\n]{0,25}?\b(?:sispann|sispandi)\b|\bsispandi\b|\bpenalite\b|\bprosekision\b|\blapolis\b"),
    ("SOC-01", "en", "contact footer", r"\burgent(?:ly)?\b|\bimmediately\b|\bright away\b|\basap\b|\bact now\b|\bwithin \d+\s*(?:minutes?|mins?|hours?|hrs?|h)\b|(?<!expires? )\bin \d+\s*(?:minutes?|hours?)\b|\bbefore midnight\b|\btoday only\b|\bexpires? (?:today|soon)\b|\blast chance\b|\bfinal (?:notice|warning|reminder)\b"),
    ("SOC-01", "fr", "contact footer", r"\burgente?\b|\bimm[ée]diatement\b|\bsans d[ée]lai\b|\bdans les \d+\s*(?:heures|minutes|h)\b|\bsous \d+\s*h\b|\bavant (?:minuit|\d+\s*h)\b|\bdernier (?:avis|rappel)\b|\bau plus vite\b"),
    ("SOC-01", "mfe", "contact", r"\bdeswit\b|\btouswit\b|\btousuit\b|\btoutswit\b|\bzordi mem\b|\bvit vit\b|\bavan minwi\b|\bavan \d+\s*h\b|\bdan \d+\s*(?:minit|er|erdtan|zour)\b"),
    ("SOC-04", "en", "", r"\b(?:whatsapp|telegram|viber) (?:me|us)\b|\b(?:contact|message|text|chat with) (?:me|us) (?:on|via) (?:whatsapp|telegram|signal|viber)\b|\bcall (?:this|the following|our) number\b|\breply to this number\b"),
    ("SOC-04", "fr", "", r"\bcontactez(?:-nous|-moi)? (?:sur|via|par) (?:whatsapp|telegram)\b|\bappelez (?:ce|le) num[ée]ro\b"),
    ("SOC-04", "mfe", "", r"\b(?:apel|telefonn) (?:lor )?sa nimero\b|\bkontakte? (?:mwa|nou) lor (?:whatsapp|telegram)\b|\b(?:whatsapp|telegram|viber) (?:mwa|nou)\b"),
    ("SOC-05", "en", "", r"\byou(?:'ve| have)? won\b|\b(?:lucky )?winner\b|\bprize\b|\blottery\b|\bjackpot\b|\beligible for a (?:tax )?refund\b|\b(?:refund|cashback) (?:of|is|pending|available|ready)\b"),
    ("SOC-05", "fr", "", r"\bvous avez gagn[ée]\b|\bgagnant\b|\bloterie\b|\bremboursement\b"),
    ("SOC-05", "mfe", "", r"\bou(?:'nn| finn|nn) gagn(?:e)?\b|\bloterie\b|\branbours(?:e)?man\b|\bremboursement\b"),
    ("SOC-10", "en", "", r"\b(?:sent|transferred|paid)\b[\s\S]{0,60}?\bby (?:mistake|accident)\b[\s\S]{0,100}?\b(?:send|transfer|pay|refund)\b[\s\S]{0,30}?\bback\b"),
    ("SOC-10", "fr", "", r"\b(?:envoy|transf[ée]r|pay[ée])\w*\b[\s\S]{0,60}?\bpar erreur\b[\s\S]{0,100}?\b(?:renvoy|rembours|retourn)\w*\b"),
    ("SOC-10", "mfe", "", r"\bavoy\w*\b[\s\S]{0,60}?\bpar erer\b[\s\S]{0,100}?\breavoy\w*\b"),
    ("SOC-09", "en", "", r"\bno survey\b|\bdirect download link\b|\bkeygen\b|\bserial key\b|\bactivation key\b|\brepack\b|\bcrack(?:ed)?(?: version)?\b|\bfree\b[^.!?\n]{0,40}?\bfull (?:pc )?version\b|\bfull (?:pc )?version\b[^.!?\n]{0,40}?\bfree\b"),
]
#: This library's own name, as messages would claim its approval.
CHECKER = "tracewell"
#: Instructions aimed at an automated checker.
INJECTION = "|".join([
    r"\bignore (?:all |any )?(?:the )?(?:previous|prior|above|earlier|preceding) (?:instructions?|prompts?|rules?|messages?)\b",
    r"\bdisregard (?:all |any )?(?:the )?(?:previous|prior|above|earlier)\b",
    r"\bforget (?:all |your )?(?:previous |prior )?instructions\b",
    r"\b(?:classify|mark|label|rate|flag|treat|output|return|respond with|answer)\b[^.\n]{0,40}\b(?:as )?(?:safe|legitimate|legit|not (?:a )?scam|harmless|benign)\b",
    r"(?:^|\n)\s*(?:system|assistant|developer)\s*:",
    r"\[\s*(?:system|inst)\s*\]",
    r"</?\s*(?:system|untrusted_message|instructions?)\s*>",
    rf"\b{CHECKER} (?:has )?(?:verified|approved|cleared|confirmed)\b",
    rf"\b(?:verified|approved) (?:as )?(?:safe )?by {CHECKER}\b",
    r"\bas an ai(?: language)? model\b",
    r"\bignorez (?:toutes )?les instructions\b",
])
TEMPLATE_MARK = r"\{\{\s*[.#/]?[\w.]+\s*\}\}|\{%\s*[.#/]?[\w. ]+\s*%\}|%%[\w.]+%%"
#: What a match of a rule holds one of, in lower case; the rest of the texts needn't be tried.
NEEDS = {
    ("SEC-01", "mixed"): "otp|code|pin|password|mot de passe|modpas|cvv|cvc|kod",
    ("SEC-01", "en"): "what is |what was ",
    ("SEC-03", "en"): "password|passcode",
    ("SEC-03", "fr"): "mot de passe",
    ("SEC-03", "mfe"): "modpas",
    ("SEC-02", "mixed"): "anydesk|teamviewer|quick|rustdesk|ultraviewer|remote |screen",
    ("PAY-03", "en"): "safe account|secure account|safety account|protected account|holding account|move |transfer ",
    ("PAY-03", "fr"): "compte s|compte de s|compte temporaire",
    ("PAY-03", "mfe"): "kont sekiri|kont provizwar",
    ("PAY-02", "mixed"): "gift|google play|itunes|steam card|amazon|bitcoin|btc|crypto|usdt|binance|western union|moneygram|cash courier|cadeau|kart kado",
    ("PAY-04", "en"): "fee|starter kit",
    ("PAY-04", "fr"): "frais d",
    ("PAY-04", "mfe"): "fre |frais ",
    ("PAY-07", "en"): " details|new account |new bank account ",
    ("PAY-07", "fr"): "changement de banque|nouveau compte|nouvelles coordonn",
    ("PAY-07", "mfe"): "detail la banque|nouvo compte|nouvo kont",
    ("PAY-01", "en"): "pay|send|transfer|deposit|remit|wire",
    ("PAY-01", "fr"): "paye|glez|gler|envoye|virez|verse|effectuer le paiement|faire un virement",
    ("PAY-01", "mfe"): "pey|avoy|envoye|fer transfer|fer enn transfer|depoz|investi|bizin rs",
    ("SOC-03", "en"): "tell |keep this |keep it |t inform |t contact |t call |between you and me|between us",
    ("SOC-03", "fr"): "n'en parle|dites |gardez ",
    ("SOC-03", "mfe"): "pa dir |pa koz|gard sa ",
    ("SOC-08", "en"): "bypass |skip |without |t go through |t involve |t copy |t cc |t loop in |no need to ",
    ("SOC-08", "fr"): "sans |contourn|inutile de ",
    ("SOC-08", "mfe"): "pa bizin |pa pas par ",
    ("SOC-02", "en"): "suspend|locked|frozen|closed|deactivated|terminated|restricted|legal action|prosecut|arrest|penalt|be fined|permanent|lose access",
    ("SOC-02", "fr"): "suspendu|bloqu|gel|sactiv|poursuites|nalit|amende",
    ("SOC-02", "mfe"): "bloke|sispan|penalite|prosekision|lapolis",
    ("SOC-01", "en"): "urgent|immediately|right away|asap|act now|within |minute|hour|before midnight|today only|expire|last chance|final ",
    ("SOC-01", "fr"): "urgent|diatement|sans d|dans les |sous |avant |dernier |au plus vite",
    ("SOC-01", "mfe"): "deswit|touswit|tousuit|toutswit|zordi mem|vit vit|avan |dan ",
    ("SOC-04", "en"): "whatsapp|telegram|viber|signal|call this number|call the following number|call our number|reply to this number",
    ("SOC-04", "fr"): "whatsapp|telegram|appelez ",
    ("SOC-04", "mfe"): "sa nimero|whatsapp|telegram|viber",
    ("SOC-05", "en"): " won|winner|prize|lottery|jackpot|refund|cashback",
    ("SOC-05", "fr"): "vous avez gagn|gagnant|loterie|remboursement",
    ("SOC-05", "mfe"): " gagn|nn gagn|loterie|ranbours|remboursement",
    ("SOC-10", "en"): "by mistake|by accident",
    ("SOC-10", "fr"): "par erreur",
    ("SOC-10", "mfe"): "par erer",
    ("SOC-09", "en"): "no survey|direct download link|keygen|serial key|activation key|repack|crack|version",
    ("SOC-07", "mixed"): f"ignore|disregard |forget |safe|legit|scam|harmless|benign|system|assistant|developer|[|untrusted_message|instruction|{CHECKER}|as an ai",
    ("ID-05", "mixed"): "{{|{%|%%",
}
NEGATION = r"\b(?:never|not|don'?t|do not|no one|nobody|ne|jamais|pa|pann|zame|zamai)\b|\bn'"
CONDITION = r"\b(?:if|unless|si|sinon|otherwise)\b"
CONTACT = "|".join([
    r"\b(?:call|contact|notify|report to)\b[^.!?\n]{0,50}?\b(?:us|your bank|the bank|customer service|mcb|sbm|absa|bank ?one|emtel|myt)\b",
    r"\bcontactez\b[^.!?\n]{0,50}?\b(?:mcb|sbm|absa|bank ?one|emtel|myt|la banque)\b",
    r"\b(?:kontakte|apel)\b[^.!?\n]{0,50}?\b(?:labank|mcb|sbm|absa|bank ?one|emtel|myt)\b",
])
FOOTER = r"\bnot the intended (?:recipient|addressee)\b|\bpas le destinataire (?:pr[ée]vu|voulu)\b|\bvous n'[êe]tes pas le destinataire\b"
PASSIVE = r"^[^.!?\n]{0,20}?\b(?:was|were|has been|had been|have been)\b[^.!?\n]{0,20}?\b(?:made|completed|done|processed|effected|carried out|received|credited|debited|initiated|authorised|authorized)\b"
PERFECTIVE = r"\b(?:finn|inn|in|pann|ti)\s+$"
DETERMINER = r"\b(?:a|an|the|this|that|your|my|enn|sa)\s+$"
# End of the fixed values.

#: A word edge that knows accented letters; only this sign takes the Unicode classes.
_EDGE = r"(?U:\b)"
_OUTSIDE = r"(?-iu:(?<![A-Za-z0-9_]))"


def java(pattern: str) -> str:
    """The pattern for Spark: letters of any case, and word edges that know accented letters.

    Where an alternative begins with an edge, a plain letter follows; so within
    a plain word the edge, which takes long, needn't be tried.
    """
    return "(?iu)" + re.sub(r"(^|\|)\\b", lambda m: m[1] + _OUTSIDE + r"\b", pattern).replace(r"\b", _EDGE)


def plain(text: Column) -> Column:
    """Lower-cased, with the other characters that stand for s, i and k where case doesn't count (ſ, ı, İ and the kelvin sign); ``NEEDS`` are looked up in it."""
    lowered = F.lower(text)
    return F.when(F.octet_length(text) == F.length(text), lowered).otherwise(F.translate(lowered, "ſı\u0307", "si"))


def may_match(lowered: Column, code: str, lang: str) -> Column:
    return reduce(operator.or_, [F.contains(lowered, F.lit(x)) for x in NEEDS[code, lang].split("|")])


@dataclass(frozen=True)
class _Match:
    text: Column
    start: Column  # code points, from 0
    found: Column

    def before(self, n: int, clause: bool = True) -> Column:
        """Up to n characters before the match, back to the clause's start at most."""
        head = F.substring(self.text, F.greatest(self.start - n + 1, F.lit(1)), F.least(self.start, F.lit(n)))
        return F.regexp_extract(head, r"[^.!?\n]*$", 0) if clause else head

    def after(self, n: int) -> Column:
        return F.substring(self.text, self.start + F.length(self.found) + 1, F.lit(n))


def _like(text: Column, pattern: str) -> Column:
    return F.rlike(text, F.lit(java(pattern)))


def _suppressed(m: _Match, guards: str) -> Column:
    out = F.lit(False)
    for g in guards.split():
        if g == "negated":
            out = out | (_like(m.before(40), NEGATION) & ~_like(m.before(40), CONDITION))
        elif g == "inner":
            out = out | (_like(m.found, NEGATION) & ~_like(F.concat(m.before(40), F.lit(" "), m.found), CONDITION))
        elif g == "noun":
            out = out | _like(m.before(10, False), DETERMINER)
        elif g == "perfective":
            out = out | _like(m.before(12, False), PERFECTIVE)
        elif g == "passive":
            out = out | _like(m.after(60), PASSIVE)
        elif g == "contact":
            out = out | _like(m.before(80), CONTACT)
        elif g == "footer":
            out = out | _like(m.before(150), FOOTER)
        elif g == "wraps":
            out = out | ~F.forall(F.slice(F.split(m.found, "\n"), 2, 1000), lambda x: F.rlike(x, F.lit(r"^\s*\p{Ll}")))
    return out


def _surviving(text: Column, pattern: str, guards: str, lang: str) -> Column:
    """The first match that no guard explains away, as (lang, start, evidence), or null.

    Only texts that match at all are taken apart. A running offset goes from
    match to match, so many matches in one text cost their number.
    """
    regex = F.lit(java(pattern))
    hit = lambda start, found: F.struct(F.lit(lang).alias("lang"), start.alias("start"), found.alias("evidence"))
    if not guards:
        return F.when(F.rlike(text, regex), hit(F.length(F.get(F.split(text, java(pattern), 2), F.lit(0))), F.regexp_extract(text, java(pattern), 0)))
    # There is a piece more than matches: the last has none.
    matches = F.zip_with(F.split(text, java(pattern), -1), F.regexp_extract_all(text, regex, F.lit(0)), lambda gap, x: F.struct(gap.alias("gap"), x.alias("found")))

    def step(state: Column, m: Column) -> Column:
        start = state["at"] + F.length(m["gap"])
        kept = F.when(m["found"].isNotNull() & state["hit"].isNull() & ~_suppressed(_Match(text, start, m["found"]), guards), hit(start, m["found"]))
        return F.struct((start + F.length(m["found"])).alias("at"), F.coalesce(state["hit"], kept).alias("hit"))

    zero = F.struct(F.lit(0).alias("at"), F.lit(None).cast("struct<lang:string,start:int,evidence:string>").alias("hit"))
    return F.when(F.rlike(text, regex), F.aggregate(matches, zero, step, lambda s: s["hit"]))


def detect(messages: DataFrame) -> DataFrame:
    """One row per message and code found: msg_id, code, lang, start, evidence.

    Patterns run once per distinct text; copies of a message share the work.
    Distinct texts are few bytes and much work, so they are dealt by number,
    which adaptive execution leaves alone. A rule's pattern is tried on texts
    that hold one of the strings it needs. The rules of a code stand in one
    coalesce, which ends at the first that matches. Messages find their text's
    hits by its 128-bit hash.
    """
    n = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = F.col("text")
    texts = offsets.computed(messages.select("text").distinct().repartition(n), lowered=plain(t))
    rules = [*RULES, ("SOC-07", "mixed", "", INJECTION), ("ID-05", "mixed", "", TEMPLATE_MARK)]
    hits = [F.struct(F.lit(code).alias("code"), F.coalesce(*[F.when(may_match(F.col("lowered"), c, lang), _surviving(t, pattern, guards, lang)) for c, lang, guards, pattern in rules if c == code]).alias("hit")) for code in dict.fromkeys(c for c, *_ in rules)]
    rows = texts.select(F.md5(t.cast("binary")).alias("key"), F.explode(F.array(*hits)).alias("x")).where("x.hit IS NOT NULL")
    keyed = messages.select("msg_id", F.md5(t.cast("binary")).alias("key"))
    return keyed.join(rows, "key").select("msg_id", "x.code", "x.hit.lang", F.col("x.hit.start").cast("long").alias("start"), "x.hit.evidence")


def detect_twice(messages: DataFrame) -> DataFrame:
    """``detect``, then again over respelled texts for codes that the first pass missed; adds ``second``.

    Start and evidence of the second pass are those of the original text.
    Each distinct text is respelled once.
    """
    first = detect(messages)
    keyed = messages.select("msg_id", F.md5(F.col("text").cast("binary")).alias("key"))
    texts = messages.where("text IS NOT NULL").select("text").distinct().repartition(int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    texts = written(spelling.respelled(texts).where("changed").select(F.md5(F.col("text").cast("binary")).alias("key"), "text", "normal", "segments"), "respelled")
    again = detect(texts.select(F.col("key").alias("msg_id"), F.col("normal").alias("text"))).where("code NOT IN ('SOC-07', 'ID-05')").withColumnRenamed("msg_id", "key")
    again = again.join(texts, "key").withColumn("spot", offsets.to_original(F.col("segments"), F.col("start").cast("int"), (F.col("start") + F.length("evidence")).cast("int"), F.length("text")))
    again = again.select("key", "code", "lang", F.col("spot.start").cast("long").alias("start"), F.substr("text", F.col("spot.start") + 1, F.col("spot.end") - F.col("spot.start")).alias("evidence"))
    missed = keyed.join(again, "key").join(first.select("msg_id", "code"), ["msg_id", "code"], "left_anti")
    return first.withColumn("second", F.lit(False)).unionByName(missed.select("msg_id", "code", "lang", "start", "evidence", F.lit(True).alias("second")))
