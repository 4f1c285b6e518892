"""Personal data: base patterns, and further spans found by weak supervision. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.llm.store import stage

KINDS = ("email", "ip", "card", "phone")
#: Found by the method alone.
MORE_KINDS = ("secret",)

#: Base patterns, one a kind. Possessive forms: they match what the greedy ones do, without going back in long runs.
#: Fixed values.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Texts without a match of these have none of the base pattern either, or none that is valid.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
#: Shapes that base patterns miss, and narrower ones, which also find what a base match has run together with its
#: neighbours: addresses with written-out signs or letters beyond ASCII, both versions of IP addresses, grouped card
#: numbers, numbers with trunk or international prefixes, and keys and tokens. Fixed values.
_SIGN = r"[\[({<](?i:%s)[\])}>]"
_HOST = rf"[\p{{L}}\p{{N}}-]{{1,63}}+(?:(?:\.|\x20?{_SIGN % 'dot'}\x20?)[\p{{L}}\p{{N}}-]{{1,63}}+)++"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_DOT = r"(?:\.|\[\.\]|\(\.\)|[\[(\x20](?i:dot)[\])\x20])"
_BREAK = r"[\x20._/\u00A0\u2010-\u2013-]"
FURTHER = {
    "email": rf"(?<![\p{{L}}\p{{N}}._%+-])[\p{{L}}\p{{N}}._%+-]{{1,64}}+(?:(?:\x20?{_SIGN % 'at'}\x20?|[@\uFF20]){_HOST}|\x20(?i:at)\x20[\p{{L}}\p{{N}}-]{{1,63}}+(?:\x20(?i:dot)\x20[\p{{L}}\p{{N}}-]{{1,63}}+)++)",
    "ip": rf"(?<![0-9]){_OCTET}(?:{_DOT}{_OCTET}){{3}}(?![0-9])|(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}}|(?:[0-9A-Fa-f]{{1,4}}:){{1,6}}(?::[0-9A-Fa-f]{{1,4}}){{1,6}})(?![0-9A-Za-z:])",
    "card": rf"(?<![0-9A-Za-z])(?:[0-9]{{14,19}}+|[0-9]{{4}}+(?:{_BREAK}[0-9]{{4}}){{3}}|[0-9]{{4}}+{_BREAK}[0-9]{{6}}{_BREAK}[0-9]{{4,5}})(?![0-9A-Za-z])",
    "phone": r"(?<![0-9])(?:\+[0-9]{1,3}+[\x20.-]?)?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
    r"|(?<![0-9])(?:\+|00)[1-9][0-9]{0,2}(?:[\x20\u00A0()./\u2010-\u2013-]{1,3}[0-9]{1,8}){2,6}(?![0-9])"
    r"|(?<![0-9])(?<![0-9][\x20/.-])\(?0[1-9][0-9]{0,4}\)?(?:[\x20/-]{1,2}[0-9]{2,8}){1,5}(?![0-9])",
    "secret": r"-----BEGIN\x20(?:[A-Z]{1,10}\x20){0,3}PRIVATE\x20KEY-----|(?<![A-Za-z0-9_-])(?:eyJ[A-Za-z0-9_-]{10,400}+\.[A-Za-z0-9_-]{10,800}+\.[A-Za-z0-9_-]{10,400}+|[A-Za-z0-9_-]{20,200}+)(?![A-Za-z0-9_-])",
}
FURTHER_NEEDS = {
    "email": rf"{_SIGN % 'at'}|\x20(?i:at)\x20[\p{{L}}\p{{N}}-]{{1,63}}+\x20(?i:dot)\x20|[@\uFF20]",
    "ip": rf"[0-9]{_DOT}[0-9]++{_DOT}[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f]{{0,4}}:[0-9A-Fa-f]",
    "card": rf"[0-9]{{4}}{_BREAK}?[0-9]{{4}}{_BREAK}?[0-9]{{4}}|[0-9]{{4}}{_BREAK}[0-9]{{6}}{_BREAK}[0-9]{{4}}",
    "phone": r"[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}|\+[1-9]|(?<![0-9])\(?0[0-9]{1,5}\)?[\x20\u00A0()./\u2010-\u2013-]{1,3}[0-9]",
    "secret": r"[A-Za-z0-9_-]{20}|-----BEGIN\x20",
}

#: Gazetteers and context words of the labelers. Fixed values.
#: Endings of host names: the generic ones in common use and the countries of the languages that texts come in.
DOMAINS = (
    "com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "name", "io", "ai", "app", "dev", "co", "me", "tv", "online", "site", "xyz", "eu",
    "at", "au", "be", "br", "ca", "ch", "cl", "cn", "cz", "de", "dk", "es", "fi", "fr", "gr", "hk", "hu", "ie", "il", "in", "it", "jp", "kr", "lu", "mx",
    "nl", "no", "nz", "pe", "pl", "pt", "ro", "ru", "se", "sg", "tr", "ua", "uk", "us", "za",
)
#: Assigned country calling codes, by zone: those of one and two digits, and the zones of three.
COUNTRY_CODES = r"^(?:00)?(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|(?:2[1-689]|3[578]|42|5[09]|6[789]|8[0578]|9[679])[0-9])"
#: Card issuers with the lengths of their numbers.
ISSUERS = r"^(?:4(?:[0-9]{15}|[0-9]{18})|(?:5[1-5]|2[2-7])[0-9]{14}|3[47][0-9]{13}|(?:6011|64|65)[0-9]{10,17}|35[0-9]{14,17}|3(?:0|6|8|9)[0-9]{12,17}|62[0-9]{14,17}|(?:50|5[6-9]|6)[0-9]{12,18})$"
#: How keys of known services begin.
KEY_PREFIXES = r"^(?:AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|sk_(?:live|test)_|xox[abprs]-|AIza|ya29|eyJ|-----BEGIN)"
SPEAKS_FOR = {
    "email": r"e-?mail|contact|write|reply|correo|courriel|adresse|kontakt",
    "ip": r"\bip\b|ipv[46]|host|server|address|login|adresse|servidor",
    "card": r"card|visa|credit|debit|pay|carte|karte|tarjeta",
    "phone": r"phone|tel|call|mobile|fax|cell|ring|handy|móvil|appel",
    "secret": r"token|secret|passw|api[\x20_-]?key|bearer|authorization|credential|private\x20key",
}
SPEAKS_AGAINST = r"version|release|isbn|order|serial|invoice|article|chapter|section|commit|checksum|sha-?[0-9]|md5|revision|date"
#: Units after a number.
UNITS = r"^\x20?(?:[%€£](?![%€£])|(?:eur|usd|kg|km|mm|cm|ms|pages?|items|units|bytes|pieces)\b)"
CONTEXT = 40


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    size = F.length(digits)
    doubled = lambda d, i: F.when((size - i) % 2 == 0, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)
    each = F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), lambda c: c.cast("int"))
    return F.aggregate(F.transform(each, doubled), F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    """Whether a value is well formed: octets and groups of addresses, the check digit of cards, the digits of phone
    numbers, and keys of random letters and digits."""
    digits, plain = _digits(value), F.regexp_replace(value, _DOT, ".")
    parts = F.transform(F.split(plain, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    octets = F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(F.try_to_number(p, F.lit("999")), F.lit(999)) <= 255))
    groups = F.size(F.filter(F.split(value, ":"), lambda g: g != ""))
    ip = F.when(value.contains("::"), groups.between(3, 7)).when(value.contains(":"), groups == 8).otherwise(octets)
    random = value.rlike(r"^[0-9A-Fa-f]{32,}$") | value.rlike(KEY_PREFIXES) | ((F.length(digits) >= 4) & ~value.rlike("[A-Za-z]{7}"))
    sized = F.length(digits).between(14, 19)
    return (
        F.when(kind == "email", F.lit(True)).when(kind == "ip", ip).when(kind == "card", F.when(sized, luhn(digits)).otherwise(False))
        .when(kind == "secret", random).otherwise(F.length(digits).between(10, 15))
    )


def _usual(kind: Column, value: Column, before: Column, after: Column) -> Column:
    """Whether a value is written the usual way: null where there is no usual way."""
    host = value.rlike(r"^[\p{L}\p{N}].*[\p{L}]{2,24}$") & ~value.contains("..")
    alone = ~value.rlike(r"(?<![0-9A-Fa-f:])0[0-9]+\.") & ~before.rlike(r"[0-9]\.$") & ~after.rlike(r"^\.[0-9]")
    grouped = value.rlike(rf"^(?:[0-9]+|[0-9]{{4}}(?:{_BREAK}[0-9]{{4}}){{3}}(?:{_BREAK}[0-9]{{1,3}})?|[0-9]{{4}}{_BREAK}[0-9]{{6}}{_BREAK}[0-9]{{4,5}})$")
    round_ones = [F.length(value) - F.length(F.translate(value, c, "")) for c in "()"]
    phone = F.when(round_ones[0] != round_ones[1], False).when(value.rlike(r"^(?:\+|0|\()"), True)
    return (
        F.when(kind == "email", host).when(kind == "ip", alone).when(kind == "card", grouped).when(kind == "phone", phone)
        .otherwise(F.when(value.rlike("^[0-9A-Fa-f]+$") & F.length(value).isin(32, 40, 48, 56, 64, 96, 128), True))
    )


def _found(text: Column, kind: str, base: bool) -> Column:
    """The matches of one pattern, each with the gap before it, of which a place follows by adding up, and what stands
    next to it on both sides."""
    pattern, needs = (BASE, NEEDS) if base else (FURTHER, FURTHER_NEEDS)
    gaps, values = F.split(text, pattern[kind], -1), F.regexp_extract_all(text, F.lit(pattern[kind]), F.lit(0))
    there = F.contains(text, F.lit("@")) if kind == "email" and base else text.rlike(needs[kind])
    after = F.transform(F.slice(gaps, F.lit(2), F.greatest(F.size(gaps) - 1, F.lit(0))), lambda g: F.left(g, F.lit(CONTEXT)))
    rows = F.transform(
        F.arrays_zip(values.alias("v"), gaps.alias("g"), after.alias("n")),
        lambda m, i: F.struct(
            F.lit(kind).alias("kind"), F.lit(base).alias("base"), i.alias("i"), m["v"].alias("value"), F.length(m["g"]).alias("gap"),
            F.right(m["g"], F.lit(CONTEXT)).alias("before"), F.coalesce(m["n"], F.lit("")).alias("after"),
        ),
    )
    return F.when(there, F.filter(rows, lambda m: m["value"].isNotNull())).otherwise(F.array().cast(_ROWS))


_ROWS = "array<struct<kind:string,base:boolean,i:int,value:string,gap:int,before:string,after:string>>"


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every match of a base or further pattern in whole texts, with its place in code points and the labelers' votes.

    Votes are 1 (personal data), 0 (not) or null (no opinion): ``by_shape`` asks whether the value is well formed,
    ``by_list`` looks it up in gazetteers (domains, issuers, country codes, address ranges, beginnings of keys),
    ``by_context`` searches for tell-tale words shortly before it, ``by_unit`` for a unit behind it, and ``by_form``
    asks whether it is written and grouped the usual way.
    """
    body = F.col(text)
    rows = docs.where(body.rlike(r"[0-9@\uFF20\[(]|-----BEGIN|\x20(?i:dot)\x20")).select(
        F.col(doc_id).alias("id"),
        F.xxhash64(text).alias("twin"),
        F.explode(F.concat(*[_found(body, k, True) for k in KINDS], *[_found(body, k, False) for k in FURTHER])).alias("m"),
    )
    rows = rows.select("id", "twin", "m.*").dropDuplicates(["id", "twin", "kind", "base", "i"])
    along = Window.partitionBy("id", "twin", "kind", "base").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(F.col("gap").cast("long") + F.length("value")).over(along))
    rows = rows.withColumn("start", F.col("end") - F.length("value"))
    kind, value, digits = F.col("kind"), F.col("value"), _digits(F.col("value"))
    # Numbers of other lengths are candidates of neither kind; a key has letters and digits; of addresses with the sign
    # itself only those beyond ASCII are new.
    wanted = (
        F.when(kind == "card", F.length(digits).between(12, 19)).when(kind == "phone", F.length(digits).between(7, 15))
        .when(kind == "secret", (value.rlike("[0-9]") & value.rlike("[A-Za-z]")) | value.startswith("-----BEGIN"))
        .when((kind == "email") & ~F.col("base"), ~value.contains("@") | value.rlike(r"[^\x00-\x7F]")).otherwise(True)
    )
    rows = rows.where(wanted)
    first = F.regexp_replace(F.split(F.regexp_replace(value, _DOT, "."), r"\.")[0], "^0+(?=[0-9])", "")
    ranged = F.when(value.contains(":"), value.rlike(r"^(?i:[23][0-9a-f]{3}|f[cd][0-9a-f]{2}|fe80):")).otherwise(~first.rlike(r"^(?:0|127|22[4-9]|2[3-9][0-9]|[0-9]{4,})$"))
    listed = (
        F.when(kind == "email", F.lower(F.regexp_extract(value, r"([A-Za-z]+)$", 1)).isin(*DOMAINS)).when(kind == "ip", ranged).when(kind == "card", digits.rlike(ISSUERS))
        .when(kind == "secret", F.when(value.rlike(KEY_PREFIXES), True)).otherwise(F.when(value.rlike(r"^(?:\+|00)"), digits.rlike(COUNTRY_CODES)))
    )
    near = F.lower("before")
    told = F.when(near.rlike(SPEAKS_AGAINST), 0)
    for k, words in SPEAKS_FOR.items():
        told = told.when((kind == k) & near.rlike(words), 1)
    shape = _valid(kind, value)
    return rows.select(
        "id", "twin", "kind", "start", "end", (F.col("base") & shape).alias("base"), (~F.col("base")).alias("further"),
        shape.cast("int").alias("by_shape"), listed.cast("int").alias("by_list"), told.alias("by_context"),
        F.when(F.lower("after").rlike(UNITS), 0).alias("by_unit"), _usual(kind, value, F.col("before"), F.col("after")).cast("int").alias("by_form"),
        F.least(F.floor(F.length(digits) / 4), F.lit(5)).cast("int").alias("digits"), F.coalesce(F.right("before", F.lit(1)).rlike(r"[\p{L}\p{N}]"), F.lit(False)).alias("joined"),
    )


_VOTES = ("by_shape", "by_list", "by_context", "by_unit", "by_form")
_FEATURES = (*_VOTES, "digits", "joined", "further")


def reliabilities(patterns: list[tuple[tuple[int | None, ...], int]], rounds: int = 50) -> tuple[float, list[list[float]]]:
    """Expectation-maximisation over vote patterns and their counts: the share of true spans, and for each labeler how
    often it votes 1 on a true and on a false one. Abstentions say nothing; one vote of each sort is added to all."""
    labelers = len(patterns[0][0]) if patterns else len(_VOTES)
    share, rate = 0.7, [[0.8, 0.3] for _ in range(labelers)]
    total = sum(n for _, n in patterns)
    for _ in range(rounds if total else 0):
        weight = [(votes, n, posterior(votes, share, rate)) for votes, n in patterns]
        share = (sum(n * q for _, n, q in weight) + 1) / (total + 2)
        for j in range(labelers):
            for truth in (0, 1):
                mass = lambda v, j=j, truth=truth: sum(n * (1 - q if truth else q) for votes, n, q in weight if votes[j] in v)
                rate[j][truth] = (mass((1,)) + (0.8, 0.3)[truth]) / (mass((0, 1)) + 1)
    return share, rate


def posterior(votes: tuple[int | None, ...], share: float, rate: list[list[float]]) -> float:
    """Probability that a span with these votes is personal data."""
    odds = math.log(share / (1 - share))
    for vote, (true, false) in zip(votes, rate, strict=True):
        if vote is not None:
            odds += math.log((true if vote else 1 - true) / (false if vote else 1 - false))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


def train_classifier(rows: list[tuple[list[str], int, float]], rounds: int = 300, rate: float = 1.0, ridge: float = 1e-3) -> dict[str, float]:
    """Logistic regression by gradient descent on distinct feature rows, their counts and their soft labels."""
    total, weights = sum(n for _, n, _ in rows) or 1, {}
    for _ in range(rounds):
        slope: dict[str, float] = {}
        for names, n, label in rows:
            odds = sum(weights.get(f, 0.0) for f in names)
            error = n / total * (1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))) - label)
            for f in names:
                slope[f] = slope.get(f, 0.0) + error
        for f, g in slope.items():
            weights[f] = weights.get(f, 0.0) - rate * (g + ridge * weights.get(f, 0.0))
    return weights


def find_personal_data(docs: DataFrame, threshold: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans of personal data in every whole text.

    Base spans are the leftmost matches of a kind's pattern that do not overlap and are valid; a failing match is
    dropped and not tried again. The method adds spans: of all other candidates, those that a classifier accepts and
    that overlap no base span of the document; of two that overlap and are of one kind, that of the narrower pattern.
    Cards with a wrong check digit and addresses with a wrong octet are never added.
    Keys and tokens are a fifth kind, which only the method finds, apart from the spans. Five labelers vote on each candidate, expectation-maximisation over
    the counts of vote patterns estimates how reliable each labeler is, and a logistic classifier over votes and
    shape learns from the resulting probabilities. Only counts of patterns, whose number the patterns' definition
    bounds, reach the driver.

    A null text counts as empty. Rows that agree in id and text get the same result each. An empty table gives an
    empty result; columns besides id and text play no part.

    Returns ``(<doc_id>, n_email, n_ip, n_card, n_phone, base, spans, secrets)``; the counts are those of base spans, the
    last three are arrays of ``(start, kind_no, end, kind)`` in the order of start and kind.
    """
    seen = stage(candidates(docs, doc_id, text), "candidates")
    counted = [(tuple(r[:-1]), r[-1]) for r in seen.groupBy(*_VOTES).count().collect()]
    share, rate = reliabilities(counted)
    table = seen.groupBy("kind", *_FEATURES).count().collect()
    name = lambda kind, feature, value: f"{kind} {feature} {value}".lower()
    rows = [([name(r["kind"], f, r[f]) for f in _FEATURES], r["count"], posterior(tuple(r[v] for v in _VOTES), share, rate)) for r in table]
    weights = train_classifier(rows)
    look_up = F.create_map(*[F.lit(x) for pair in (weights or {"none": 0.0}).items() for x in pair])
    odds = F.lit(0.0)
    for f in _FEATURES:
        odds = odds + F.coalesce(F.try_element_at(look_up, F.concat(F.col("kind"), F.lit(f" {f.lower()} "), F.coalesce(F.col(f).cast("string"), F.lit("none")))), F.lit(0.0))
    possible = ~F.col("kind").isin("ip", "card") | (F.col("by_shape") == 1)  # a wrong check digit or octet proves that it is none
    scored = seen.withColumn("added", ~F.col("base") & possible & (1 / (1 + F.exp(-odds)) >= threshold)).where("base OR added")
    by_place = Window.partitionBy("id", "twin").orderBy("start", "end")
    reach = F.max(F.when(F.col("base"), F.col("end"))).over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    following = F.min(F.when(F.col("base"), F.col("start"))).over(by_place.rowsBetween(1, Window.unboundedFollowing))
    free = (F.coalesce(reach, F.lit(0)) <= F.col("start")) & (F.coalesce(following, F.col("end")) >= F.col("end"))
    scored = scored.withColumn("free", free).where("base OR free")
    # What is left of one kind is narrower matches and failed base ones, each without overlaps among themselves.
    narrow, of_kind = F.col("further") & F.col("added"), Window.partitionBy("id", "twin", "kind").orderBy("start", "end")
    before = F.max(F.when(narrow, F.col("end"))).over(of_kind.rowsBetween(Window.unboundedPreceding, -1))
    behind = F.min(F.when(narrow, F.col("start"))).over(of_kind.rowsBetween(1, Window.unboundedFollowing))
    alone = (F.coalesce(before, F.lit(0)) <= F.col("start")) & (F.coalesce(behind, F.col("end")) >= F.col("end"))
    clear = scored.withColumn("alone", alone).where("base OR further OR alone")
    number = F.array_position(F.array(*map(F.lit, KINDS + MORE_KINDS)), F.col("kind")).cast("int")
    span = F.struct("start", number.alias("kind_no"), "end", "kind")
    spans = clear.groupBy("id", "twin").agg(
        *[F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in KINDS],
        F.sort_array(F.collect_list(F.when(F.col("base"), span))).alias("base"),
        F.sort_array(F.collect_list(F.when(F.col("kind").isin(*KINDS), span))).alias("spans"),
        F.sort_array(F.collect_list(F.when(F.col("kind").isin(*MORE_KINDS), span))).alias("secrets"),
    )
    keyed = docs.select(F.col(doc_id), F.xxhash64(text).alias("__twin"))
    found = keyed.join(spans, F.col(doc_id).eqNullSafe(F.col("id")) & (F.col("__twin") == F.col("twin")), "left")
    empty = F.array().cast("array<struct<start:bigint,kind_no:int,end:bigint,kind:string>>")
    return found.select(doc_id, *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS], *[F.coalesce(c, empty).alias(c) for c in ("base", "spans", "secrets")])


def written(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
