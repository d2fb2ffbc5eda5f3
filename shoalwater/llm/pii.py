"""Personal data by weakly supervised labelers.

Base patterns find e-mail addresses, IPv4 addresses, card and phone numbers;
wider patterns find further candidates: digit groups that are none of these
(also the parts of a longer run), handles, bank account numbers, names of
people and postal addresses.  On every candidate four labelers vote yes, no or
abstain: the shape of the match (regex and checksums), a gazetteer (mail
providers, reserved networks, issuer prefixes, country codes, first names,
towns, words that are no handle or name), the words before it (context), and
what it touches.  Expectation-maximisation estimates each labeler's reliability
for each kind from agreement alone; a logistic span classifier is then trained
on the resulting probabilities over the votes and over what no labeler looks
at: length and composition of the span.  Base spans always stay; other
candidates are added where the classifier says so.

Plan.  One scan of the texts, built-in expressions only, writes the candidates
without text.  Everything the model needs is the number of candidates with each
combination of votes and features: ``CODES`` for each kind at most, whatever the
corpus size.  The classifier's decisions go back as a literal array of
combinations, so no join is needed.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalwater.llm.spans import listed, matches
from shoalwater.scratch import Scratch

KINDS = ("email", "ip", "card", "phone", "number", "handle", "iban", "name", "address")
BASE_KINDS = 4
#: Possessive forms of the stated patterns: the same matches, but no backtracking and no recursion on long texts.
#: An attempt may begin inside a run of local-part characters only right after the previous match.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
HANDLE = r"(?:(?<![A-Za-z0-9._%+@-])|\G)@[A-Za-z][A-Za-z0-9_]{2,30}(?![A-Za-z0-9_.@-])"
#: 13 to 19 digits next to other digits: part of a run that may be no card number as a whole.
GROUP = r"(?<=[0-9]\x20)[0-9]{13,19}(?=[\s.,;:!?)]|$)|(?<![^\s])[0-9]{13,19}(?=\x20[0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_CAPITAL, _SMALL = "A-ZÀ-ÖØ-Þ", "a-zà-öø-ÿ"
NAME = f"(?<![{_CAPITAL}{_SMALL}0-9])[{_CAPITAL}][{_SMALL}]++(?:[\\x20-][{_CAPITAL}][{_SMALL}]++){{1,2}}"
_WORD = f"[{_CAPITAL}][{_CAPITAL}{_SMALL}'-]*+"
#: English, French, German and Spanish order of number, kind of street and name.
ADDRESS = (
    f"(?<![0-9])[0-9]{{1,5}}[a-z]?,?\\x20(?:{_WORD}\\x20){{1,3}}(?:Street|Avenue|Road|Lane|Drive|Boulevard|Court|Square|St|Ave|Rd|Blvd)(?![A-Za-z])"
    f"|(?<![0-9])[0-9]{{1,5}}(?:\\x20bis)?,?\\x20(?:rue|avenue|boulevard|place|chemin|allée)\\x20(?:(?:de|du|des|la|le)\\x20){{0,2}}{_WORD}"
    f"|[{_CAPITAL}][{_SMALL}]*(?:straße|strasse|gasse|weg|platz|allee)\\x20[0-9]{{1,4}}[a-z]?(?![0-9A-Za-z])"
    f"|(?:Calle|Avenida|Plaza|Paseo)\\x20(?:(?:de|del|la|las|los)\\x20){{0,2}}{_WORD},?\\x20[0-9]{{1,4}}(?![0-9])"
)

#: Gazetteers (fixed values).
MAIL_PROVIDERS = "(?i)@(?:[a-z0-9-]+\\.)*(?:gmail|googlemail|yahoo|outlook|hotmail|live|icloud|proton|gmx|web|orange|free|example)\\.[a-z.]+$"
RESERVED_NETWORK = r"^(?:0|10|127|224|239|255)\.|^192\.168\.|^169\.254\."
ISSUER = "^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)"
COUNTRY = r"^\+(?:1|7|20|27|3[0-4]|36|39|4[0-9]|5[1-8]|6[0-6]|8[1246]|86|9[0-58]|351|352|353|354|358|420|886|852)(?![0-9]{13})"
NO_HANDLE = "(?i)^@(?:media|import|charset|param|return|returns|throws|override|deprecated|author|version|see|since|include|require|property|font|page|keyframes|supports|todo|everyone|here|channel|all)$"
IBAN_COUNTRY = "^(?:AD|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IS|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SE|SI|SK|SM|TR|VA)"
FIRST_NAMES = (
    "James|John|Robert|Michael|William|David|Richard|Joseph|Thomas|Charles|Mary|Patricia|Jennifer|Linda|Elizabeth|Barbara|Susan|Jessica|Sarah|Karen|Daniel|Matthew|Anthony|Mark|Paul|Steven|Andrew|Emma|Olivia|Alice|Peter|Anna|Laura"
    "|Hans|Klaus|Jürgen|Wolfgang|Dieter|Stefan|Andreas|Matthias|Ursula|Monika|Petra|Sabine|Heike|Greta|Lukas|Jonas"
    "|Jean|Pierre|Michel|Philippe|Alain|Nicolas|Marie|Nathalie|Isabelle|Sylvie|Camille|Chloé|Léa|Luc|Élise"
    "|José|Antonio|Manuel|Francisco|Juan|Carlos|Miguel|María|Carmen|Ana|Isabel|Lucía|Marta|Pilar|Sofía|Diego"
)
NO_NAME = (
    "License|Licence|Version|Public|General|Street|Avenue|Road|University|Institute|Company|Inc|Ltd|January|February|March|April|May|June|July|August|September|October|November|December"
    "|Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday|The|This|That|These|North|South|East|West|United|New|Rights|Reserved|Terms|Privacy|Policy|Chapter|Section|Table|Figure"
)
TOWNS = "(?i)^,?\\s*(?:[A-Z]{0,2}-?[0-9]{4,5}\\b|london|paris|berlin|madrid|new york|munich|münchen|hamburg|köln|lyon|marseille|barcelona|sevilla|boston|chicago|vienna|wien|zürich)"
#: Words that speak for a kind, and words that speak against any (fixed values; English, German, French, Spanish).
CONTEXT = (
    "e-?mail|mail|correo|courriel|kontakt|contact", "\\bip\\b|address|adresse|host|server", "card|visa|master|amex|karte|carte|tarjeta",
    "phone|tel|call|mobile|fax|anruf|telefon|llam", "account|iban|ssn|passport|konto|compte|cuenta|\\bid\\b|card|visa|karte|carte|tarjeta", "twitter|follow|instagram|user|handle",
    "iban|account|bank|konto|compte|cuenta", "\\b(?:mr|mrs|ms|dr|prof|herr|frau|mme|sr|sra|señor|señora|monsieur|madame|name is|named|signed|dear|sincerely|contact)\\b\\.?,?\\s*$",
    "address|adresse|lives|living|wohn|habite|dirección|domicil|located|situé|deliver|ship",
)
AGAINST = "version|build|order|invoice|commit|release|isbn|token|sha|hash|key|license|licence|under the"

_FULL = "array<struct<kind:int,start:int,end:int,base:boolean,code:int>>"
ABSTAIN, NO, YES = 0, 1, 2
#: Votes are packed in base 3, then a length class of four and a composition class of four.
CODES = 3**4 * 16


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(no, NO).when(yes, YES).otherwise(ABSTAIN)


def packed(votes: tuple[int, int, int, int], length: int, make: int) -> int:
    """The number that stands for votes (shape, gazetteer, context, touch) and features."""
    a, b, c, d = votes
    return ((((a * 3 + b) * 3 + c) * 3 + d) * 4 + length) * 4 + make


def _candidate(kind: int, start: Column, end: Column, value: Column, before: Column, after: Column, base: Column, shape: Column, gazetteer: Column) -> Column:
    said = F.right(before, F.lit(40))
    context = _vote(F.regexp_like(said, F.lit(f"(?i){CONTEXT[kind]}")), F.regexp_like(said, F.lit(f"(?i)(?:{AGAINST})[^A-Za-z]*$")))
    touches = F.regexp_like(F.right(before, F.lit(1)), F.lit("[A-Za-z0-9_=#$/\"']")) | F.regexp_like(F.left(after, F.lit(1)), F.lit("[A-Za-z0-9_=#$/\"']"))
    free = F.regexp_like(F.right(before, F.lit(1)), F.lit(r"^$|[\s(<:,;]")) & F.regexp_like(F.left(after, F.lit(1)), F.lit(r"^$|[\s)>.,;:!?]"))
    length = F.least(F.floor((end - start) / 8), F.lit(3)).cast("int")
    make = F.when(F.regexp_like(value, F.lit("^[0-9]+$")), 0).when(F.regexp_like(value, F.lit("^[^0-9]+$")), 1).when(F.regexp_like(value, F.lit("^[^A-Za-z]+$")), 2).otherwise(3)
    code = ((((shape * 3 + gazetteer) * 3 + context) * 3 + _vote(free, touches)) * 4 + length) * 4 + make
    return F.struct(F.lit(kind).alias("kind"), start.cast("int").alias("start"), end.cast("int").alias("end"), base.alias("base"), code.cast("int").alias("code"))


def _remainder_97(value: Column) -> Column:
    """Check digits of a bank account number: letters count from 10, the first four characters go last."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 64), F.left(plain, F.lit(4)))

    def fold(acc: Column, c: Column) -> Column:
        n = F.ascii(c)
        return F.when(n < 65, (acc * 10 + n - 48) % 97).otherwise((acc * 100 + n - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), fold)


def candidates(text: str) -> Column:
    """Candidate spans of the column ``text``, kind by kind, each in order of start."""
    yes, no = F.lit(True), F.lit(False)

    def email(start, end, value, before, after):
        return _candidate(0, start, end, value, before, after, yes, _vote(F.regexp_like(value, F.lit(r"\.[A-Za-z]{2,}$")), F.regexp_like(value, F.lit(r"\.[0-9]+$|^[.-]"))), _vote(F.regexp_like(value, F.lit(MAIL_PROVIDERS)), no))

    def ip(start, end, value, before, after):
        part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        fits = F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.lpad(F.left(part(p), F.lit(3)), 3, "0") <= "255"))
        made = _candidate(1, start, end, value, before, after, yes, _vote(F.regexp_like(value, F.lit(r"^[1-9]")), F.regexp_like(value, F.lit(r"(?:^|\.)0[0-9]")) | F.regexp_like(F.right(before, F.lit(1)), F.lit(r"[.]"))), _vote(no, F.regexp_like(value, F.lit(RESERVED_NETWORK))))
        return F.struct(made.alias("c"), fits.alias("fits"))

    def card(start, end, value, before, after):
        digits = F.regexp_replace(value, "[^0-9]", "")
        n = F.length(digits)
        base = n.between(16, 19) & _luhn(F.when(n <= 19, digits).otherwise(F.lit("1")))
        shape = _vote(F.regexp_like(value, F.lit(r"^[0-9]{16}$|^[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}$")), F.regexp_like(value, F.lit(r"[ -][0-9][ -]")))
        as_card = _candidate(2, start, end, value, before, after, yes, shape, _vote(F.regexp_like(digits, F.lit(ISSUER)), F.regexp_like(digits, F.lit("^0"))))
        grouped = _vote(F.regexp_like(value, F.lit(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$|^[0-9]{3}[ -][0-9]{3}[ -][0-9]{4}$")), F.regexp_like(value, F.lit(r"^[0-9]{14,}$|[ -][0-9][ -]")))
        as_number = _candidate(4, start, end, value, before, after, no, grouped, _vote(no, F.regexp_like(digits, F.lit(r"^(?:0{3}|9{3}|1234)|^(?:19|20)[0-9]{6}$"))))
        other = n.between(9, 19) & ~F.regexp_like(F.right(before, F.lit(2)), F.lit(r"[+.]|[0-9][)]"))
        return F.struct(F.when(base, as_card).otherwise(as_number).alias("c"), (base | other).alias("fits"))

    def phone(start, end, value, before, after):
        n = F.length(F.regexp_replace(value, "[^0-9]", ""))
        made = _candidate(3, start, end, value, before, after, yes, _vote(F.regexp_like(value, F.lit(r"^\+[0-9]{1,3}[ (.-]")), F.regexp_like(value, F.lit(r"\.\.|--|[(][^)]*$"))), _vote(F.regexp_like(value, F.lit(COUNTRY)), F.regexp_like(value, F.lit(r"^\+0"))))
        return F.struct(made.alias("c"), n.between(8, 15).alias("fits"))

    def group(start, end, value, before, after):
        """A digit group inside a run that is no card number as a whole."""
        shape = _vote(_luhn(value), F.regexp_like(value, F.lit("^(?:0{3}|9{3}|1234)")))
        return _candidate(4, start, end, value, before, after, no, shape, _vote(F.regexp_like(value, F.lit(ISSUER)), F.regexp_like(value, F.lit(r"^(?:19|20)[0-9]{12}$"))))

    def handle(start, end, value, before, after):
        return _candidate(5, start, end, value, before, after, no, _vote(F.regexp_like(value, F.lit("[0-9_]|[a-z][A-Z]")), F.regexp_like(value, F.lit("^@[A-Z]+$"))), _vote(no, F.regexp_like(value, F.lit(NO_HANDLE))))

    def iban(start, end, value, before, after):
        return _candidate(6, start, end, value, before, after, no, _vote(_remainder_97(value) == 1, _remainder_97(value) != 1), _vote(F.regexp_like(value, F.lit(IBAN_COUNTRY)), ~F.regexp_like(value, F.lit(IBAN_COUNTRY))))

    def name(start, end, value, before, after):
        shape = _vote(no, F.regexp_like(value, F.lit(r"^([^ -]+)[ -]\1(?:[ -]|$)|(?:^|[ -])[^ -]{1,2}(?:[ -]|$)")))
        listed_name = F.regexp_like(value, F.lit(f"^(?:{FIRST_NAMES})[ -]"))
        return _candidate(7, start, end, value, before, after, no, shape, _vote(listed_name, F.regexp_like(value, F.lit(f"(?:^|[ -])(?:{NO_NAME})(?:[ -]|$)"))))

    def address(start, end, value, before, after):
        shape = _vote(F.regexp_like(value, F.lit(r"[0-9]{1,4}[a-z]?$|^[0-9]{1,4}[a-z,]? ")), F.regexp_like(value, F.lit("^0")))
        return _candidate(8, start, end, value, before, after, no, shape, _vote(F.regexp_like(F.left(after, F.lit(24)), F.lit(TOWNS)), no))

    wrapped = _FULL.replace("array<", "array<struct<c:", 1).replace(">>", ">,fits:boolean>>")

    def fitting(pattern: str, make, hint: str = "true") -> Column:
        return F.transform(F.filter(matches(text, pattern, make, wrapped, hint=hint), lambda x: x["fits"]), lambda x: x["c"])

    at, dot, plus = (f"contains({text}, '{c}')" for c in "@.+")
    return F.concat(
        matches(text, EMAIL, email, _FULL, hint=at), fitting(IP, ip, dot), fitting(CARD, card), fitting(PHONE, phone, plus), matches(text, GROUP, group, _FULL),
        matches(text, HANDLE, handle, _FULL, hint=at), matches(text, IBAN, iban, _FULL), matches(text, NAME, name, _FULL), matches(text, ADDRESS, address, _FULL),
    )


def _unpack(code: int) -> tuple[int, int, int, int, int, int]:
    """(shape, gazetteer, context, touch, length class, composition class)."""
    votes, rest = divmod(code, 16)
    return votes // 27, votes // 9 % 3, votes // 3 % 3, votes % 3, rest // 4, rest % 4


def supported(code: int) -> bool:
    """Whether a labeler that looks at contents (shape, gazetteer, context) votes yes; nothing is added that none speaks for."""
    return YES in _unpack(code)[:3]


def reliabilities(counts: dict[tuple[int, int], int], rounds: int = 50) -> tuple[dict[int, float], dict[tuple[int, int, int, int], float]]:
    """Expectation-maximisation over (kind, code) counts.

    Returns the share of personal data for each kind and, for (kind, labeler,
    class, vote), the probability of the vote.  It starts from labelers that are
    right more often than not, so that class 1 means personal, and from a share
    of one in five (one in two for the base kinds) that counts as ten candidates.
    """
    start = {0: (0.4, 0.4, 0.2), 1: (0.4, 0.1, 0.5)}
    expected = {k: 0.5 if k < BASE_KINDS else 0.2 for k in range(len(KINDS))}
    share = dict(expected)
    says = {(k, j, y, v): start[y][v] for k in share for j in range(4) for y in (0, 1) for v in range(3)}
    for _ in range(rounds):
        mass: dict = defaultdict(float)
        for (k, code), n in sorted(counts.items()):
            p = posterior(k, code, share, says)
            for y, w in ((1, p * n), (0, (1 - p) * n)):
                mass[k, y] += w
                for j, v in enumerate(_unpack(code)[:4]):
                    mass[k, j, y, v] += w
        for k in share:
            total = mass[k, 0] + mass[k, 1]
            share[k] = (mass[k, 1] + 10 * expected[k]) / (total + 10)
            for j in range(4):
                for y in (0, 1):
                    for v in range(3):  # the start acts as ten earlier votes
                        says[k, j, y, v] = (mass[k, j, y, v] + 10 * start[y][v]) / (mass[k, y] + 10)
    return share, says


def posterior(kind: int, code: int, share: dict, says: dict) -> float:
    """Probability that a candidate with these votes is personal data."""
    odds = math.log(share[kind]) - math.log(1 - share[kind])
    for j, v in enumerate(_unpack(code)[:4]):
        odds += math.log(says[kind, j, 1, v]) - math.log(says[kind, j, 0, v])
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


def train(counts: dict[tuple[int, int], int], rounds: int = 400, rate: float = 2.0) -> dict[tuple[int, int], float]:
    """A logistic classifier on kind, votes, length and composition, trained on the posteriors; its probability for each (kind, code)."""
    share, says = reliabilities(counts)
    keys = sorted(counts)
    total = sum(counts.values()) or 1
    soft = {x: posterior(*x, share, says) for x in keys}
    feats = {(k, c): [("kind", k), *(("vote", k, j, v) for j, v in enumerate(_unpack(c)[:4])), ("length", k, _unpack(c)[4]), ("make", k, _unpack(c)[5])] for k, c in keys}
    weight: dict = defaultdict(float)
    size: dict = defaultdict(float)
    for x in keys:
        for f in feats[x]:
            size[f] += counts[x] / total

    def chance(x: tuple[int, int]) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, sum(weight[f] for f in feats[x])))))

    for _ in range(rounds):
        step: dict = defaultdict(float)
        for x in keys:
            error = (soft[x] - chance(x)) * counts[x] / total
            for f in feats[x]:
                step[f] += error
        for f, g in step.items():
            weight[f] += rate * (g / (size[f] + 1e-6) / 3 - 1e-4 * weight[f])
    return {x: chance(x) for x in keys}


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: (id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added).

    ``spans`` lists kind:start:end (code points, end exclusive) by kind, then
    start: all base spans, and others whose classifier probability is at least
    ``least`` and for which a labeler of contents votes; ``base_sha256`` digests the list of base spans.  A null
    text counts as empty (no spans).  Spans of different kinds may overlap.
    Repeated rows get equal results and each counts in the estimates; an empty
    table gives no rows; other columns are ignored.  Texts are read whole.
    """
    work = Scratch(docs.sparkSession, "pii")
    text = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = work.put(text.select("doc", candidates("text").alias("found")), "found")
    each = found.where(F.size("found") > 0).select(F.explode("found").alias("c"))
    counts = {(r.kind, r.code): r.n for r in each.groupBy("c.kind", "c.code").agg(F.count("*").alias("n")).collect()}
    accepted = [k * CODES + c for (k, c), p in sorted(train(counts).items()) if p >= least and supported(c)]
    added = F.array(*map(F.lit, accepted)) if accepted else F.array().cast("array<int>")
    order = F.array_sort(F.transform("all", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"))))
    kept = F.filter("found", lambda s: s["base"] | F.array_contains(added, s["kind"] * CODES + s["code"]))
    rows = found.select("doc", kept.alias("all")).select("doc", order.alias("all"))
    count = lambda n: F.size(F.filter("all", lambda s: s["kind"] == n)).cast("long")
    return rows.select(
        F.col("doc").alias(id_col), count(0).alias("n_email"), count(1).alias("n_ip"), count(2).alias("n_card"), count(3).alias("n_phone"),
        F.sha2(listed(F.filter("all", lambda s: s["base"]), KINDS), 256).alias("base_sha256"),
        listed(F.col("all"), KINDS).alias("spans"),
        F.size(F.filter("all", lambda s: ~s["base"])).cast("long").alias("n_added"),
    )
