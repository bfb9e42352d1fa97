"""Personal data in texts: patterns propose spans, checksums confirm them, context words adjust their score.

DataFrame functions only. A pattern's matches and what lies between them (``split`` with the same pattern) give every
match's place in code points: the lengths are summed up in blocks of about the square root of their number, so no array
grows by one element for every match. What stands around a span, and what redaction leaves between spans, is cut out
of the text's pieces of PIECE code points and not counted from its start. Patterns start only where a run of their characters starts or where the last match
ended, and never give characters back where that cannot matter, so long runs stay linear.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, unused

SPAN = "array<struct<kind:string,start:int,end:int,text:string,score:double>>"
#: A span is reported from this score on.
LEAST_SCORE = 0.5
#: Code points before and after a span in which context words count.
REACH = 40
#: Code points of the pieces that texts are cut from.
PIECE = 1024


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _count(text: Column, least: int, most: int) -> Column:
    return F.length(_digits(text)).between(least, most)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn checksum."""
    parts = F.split(F.reverse(digits), "")

    def add(total: Column, i: Column) -> Column:
        d = F.get(parts, i).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number (letters and digits, country and check digits first) has remainder 1 modulo 97."""
    moved = F.concat(F.substring(account, 5, 64), F.substring(account, 1, 4))

    def add(rest: Column, c: Column) -> Column:
        letter = F.ascii(c) >= 65
        value = F.when(letter, F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
        return (rest * F.when(letter, F.lit(100)).otherwise(F.lit(10)) + value) % 97

    return F.aggregate(F.split(moved, ""), F.lit(0), lambda rest, c: F.when(c == "", rest).otherwise(add(rest, c))) == 1


@dataclass(frozen=True)
class Kind:
    """``score`` is that of a confirmed match, ``context`` the words that raise it by ``bonus``, whole and in any case."""

    name: str
    pattern: str
    confirm: object
    score: float
    context: str
    needs: str = ""
    bonus: float = 0.3
    #: Code points a match uses up if its span is the pattern's first group, looked ahead at; 0: the match is the span.
    takes: int = 0


# What each kind looks like, in the order in which spans are listed.
BASE_KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: F.lit(True), 0.7, "e?mails?|contact|write|reach", "@"),
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        lambda t: F.forall(F.split(t, r"\."), lambda x: x.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")),
        0.6,
        "ips?|hosts?|servers?|address(?:es)?",
        ".",
    ),
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])", lambda t: luhn(_digits(t)), 0.6, "cards?|visa|credit|debit|payment"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", lambda t: _count(t, 9, 15), 0.6, "phones?|tel|telephone|call|mobile|fax", "+"),
)
#: Length of an IBAN by country: the ISO 13616 registry, territories that use its formats, and countries in partial use.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "AX DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE GG IE IM JE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST",
    26: "DZ IR IS TR", 27: "BI BL CF CG CM DJ FR GA GF GP GQ GR IT KM MC MF MG MQ MR NC PF PM RE SM TD TF WF YT",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_KNOWN = "|".join(c for codes in IBAN_LENGTHS.values() for c in codes.split())
#: By fixed length where the country is known, else the whole run of groups.
_IBAN = "|".join(
    [f"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, codes in IBAN_LENGTHS.items()] + [f"(?!{_KNOWN})[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{11,30}}+"]
)
MORE_KINDS = (
    # spans are looked ahead at, so that a refused one hides no IBAN that starts inside it; before the countries are
    # tried, the next four characters must fit
    Kind("iban", rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?=((?:{_IBAN})(?![A-Za-z0-9])))[A-Z]{{2}}[0-9]{{2}}", lambda t: mod97(F.regexp_replace(t, " ", "")), 0.6, "ibans?|accounts?|bank|konto|compte|cuenta", takes=4),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", lambda t: F.lit(True), 0.3, "ssns?|social security|taxpayer"),
)


def _with(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often and wherever it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def _before_each(values: Column, zero: Column, step) -> Column:
    """For each of ``values`` (bound, not computed) what ``step``, which is associative, makes of ``zero`` and all
    values before it. A block is folded by itself, then what lies before it is added to its results."""
    width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(values)))).cast("int")
    nothing = F.array().cast("array<int>")

    def folded(block: Column) -> Column:
        start = F.struct(zero.alias("all"), nothing.alias("before"))
        return F.aggregate(block, start, lambda s, x: F.struct(step(s["all"], x).alias("all"), F.array_append(s["before"], s["all"]).alias("before")))

    def joined(blocks: Column) -> Column:
        offsets = folded(F.transform(blocks, lambda b: b["all"]))["before"]
        return F.flatten(F.zip_with(blocks, offsets, lambda b, o: F.transform(b["before"], lambda x: step(o, x))))

    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(values) / width).cast("int") - 1)), lambda k: folded(F.slice(values, k * width + 1, width)))
    return F.when(F.size(values) > 0, _with(blocks, joined)).otherwise(nothing)


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def _part(pieces: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` (exclusive) of the text whose ``pieces`` these are."""
    first = F.floor(start / PIECE).cast("int")
    own = F.slice(pieces, first + 1, F.floor(end / PIECE).cast("int") - first + 1)
    return F.when(end > start, F.substring(F.array_join(own, ""), start - first * PIECE + 1, end - start)).otherwise("")


def _located(text: Column, matches: Column, pattern: str, takes: int) -> Column:
    """array<struct<start, end, text>> of ``matches``, the matches of ``pattern`` in ``text``; see ``Kind.takes``."""

    def placed(steps: Column) -> Column:
        lengths = F.transform(steps, lambda x: x["skip"] + (takes or F.length(x["text"])))
        starts = _with(lengths, lambda n: _before_each(n, F.lit(0), lambda a, b: a + b))

        def span(x: Column, before: Column) -> Column:
            begin = before + x["skip"]
            return F.struct(begin.alias("start"), (begin + F.length(x["text"])).alias("end"), x["text"].alias("text"))

        return F.zip_with(steps, starts, span)

    between = F.split(text, pattern, -1)
    return _with(F.zip_with(F.slice(between, 1, F.size(matches)), matches, lambda b, m: F.struct(F.length(b).alias("skip"), m.alias("text"))), placed)


def _confirmed(kind: Kind, text: Column, matches: Column) -> Column:
    """The spans of one kind from its matches in ``text``, checked and scored."""
    spans = F.filter(_located(text, matches, kind.pattern, kind.takes), lambda s: kind.confirm(s["text"]))

    def scored(whole: Column, s: Column) -> Column:
        pieces, n = whole["pieces"], whole["n"]
        before, after = F.greatest(s["start"] - REACH, F.lit(0)), F.least(s["end"] + REACH, n)
        left, right = _part(pieces, before, s["start"]), _part(pieces, s["end"], after)
        # a word that the reach cuts off is none
        left = F.when(before > 0, F.regexp_replace(left, r"^[\p{L}\p{N}]+", "")).otherwise(left)
        right = F.when(after == s["end"] + REACH, F.regexp_replace(right, r"[\p{L}\p{N}]+$", "")).otherwise(right)
        near = F.concat(left, F.lit(" "), right)
        words = rf"(?<![\p{{L}}\p{{N}}])(?:{kind.context})(?![\p{{L}}\p{{N}}])"
        score = F.lit(kind.score) + F.when(F.lower(near).rlike(words), F.lit(kind.bonus)).otherwise(F.lit(0.0))
        return F.struct(F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), F.least(score, F.lit(1.0)).alias("score"))

    def kept(whole: Column) -> Column:
        return F.filter(F.transform(spans, lambda s: scored(whole, s)), lambda s: s["score"] >= LEAST_SCORE)

    whole = F.struct(_pieces(text).alias("pieces"), F.length(text).alias("n"))
    return F.when(F.size(matches) > 0, _with(whole, kept)).otherwise(F.array().cast(SPAN))


def find_pii(docs: DataFrame, text: str = "text", into: str = "pii", kinds: tuple[Kind, ...] = (*BASE_KINDS, *MORE_KINDS)) -> DataFrame:
    """Adds ``into``: an array of (kind, start, end, text, score), by kind in the given order, then start.

    Places are code points from 0, ends exclusive. Null texts count as empty and have no spans. Matches that their
    check refuses are dropped; the score of the others rises if a context word stands within REACH code points, and
    spans below LEAST_SCORE are left out. Kinds are found independently, so spans of two kinds may overlap. Other
    columns stay as they are, whatever their names; only an existing ``into`` is replaced. Repeated rows have the same
    spans each, and an empty table gives no rows.
    """
    whole_text, *names = unused(docs, "_text", *[f"_{k.name}" for k in kinds])
    whole = docs.withColumn(whole_text, text_or_empty(text))
    nothing = F.array().cast("array<string>")
    for k, name in zip(kinds, names, strict=True):
        matches = F.regexp_extract_all(whole_text, F.lit(k.pattern), F.lit(1 if k.takes else 0))
        whole = whole.withColumn(name, F.when(F.contains(F.col(whole_text), F.lit(k.needs)), matches).otherwise(nothing) if k.needs else matches)
    found = [_confirmed(k, F.col(whole_text), F.col(name)) for k, name in zip(kinds, names, strict=True)]
    return whole.withColumn(into, F.concat(*found)).drop(whole_text, *names)


def redact(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("neg"), s["kind"].alias("kind"))))
    ends = lambda sorted_: F.transform(sorted_, lambda s: -s["neg"])

    def replaced(given: Column) -> Column:
        covered = _with(ends(given["spans"]), lambda e: _before_each(e, F.lit(0), lambda a, b: F.greatest(a, b)))
        # what lies before a span that starts where nothing covers it, and its kind
        told = lambda s, at: F.when(s["start"] >= at, F.concat(_part(given["pieces"], at, s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")
        last = F.array_max(ends(given["spans"]))
        return F.concat(F.array_join(F.zip_with(given["spans"], covered, told), ""), _part(given["pieces"], last, given["n"]))

    bound = F.struct(ordered.alias("spans"), _pieces(text).alias("pieces"), F.length(text).alias("n"))
    return F.when(F.size(spans) > 0, _with(bound, replaced)).otherwise(text)


def pii_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (of the base spans as ``kind:start:end``
    joined by commas), spans (all of them, joined likewise) and scores in the same order. Rows are kept one for one."""
    found = find_pii(docs.select("doc_id", "text"))
    base = [k.name for k in BASE_KINDS]

    def told(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(n) for n in base],
        F.sha2(told(F.filter("pii", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        told(F.col("pii")).alias("spans"),
        F.array_join(F.transform("pii", lambda s: F.format_string("%.2f", s["score"])), ",").alias("scores"),
    )
