"""Personal data in texts, with DataFrame operations only.

Regular expressions propose spans, checks confirm them (part sizes, digit counts, Luhn,
mod 97), and words that stand near a span, before or after it up to the next match of its kind, raise
its score; they count as whole words only.  Offsets are code points: a text
split by a pattern gives the gaps between its matches, so starts are running sums of gap and
match lengths.  Patterns are written with possessive quantifiers where that changes no match,
which keeps the matcher's stack flat on very long runs.  A run of characters that may open a
match is tried from its start only (or from the end of the match before), as a later start in
the same run could not succeed where that fails; so the work stays linear in the text.

Spans of the four base kinds are kept whatever their score.  The two further kinds, ``iban``
and ``ssn``, are added if their check holds and their score reaches ``least_score``.

Edge cases: a null text counts as empty and has no spans; an empty table gives an empty
result; repeated rows are each answered; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kind, pattern, character or class that must occur at all, score without and with context, context words.
BASE = (
    ("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, 0.99, "e-?mails?|contact|write to|correo|courriel|kontakt"),
    ("ip", r"(?:(?<![0-9])|\G)[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)", ".", 0.6, 0.9, "ip|address(?:es)?|hosts?|servers?|login|adresse|direcci[oó]n"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", None, 0.7, 0.99, "cards?|visa|credit|pay|paid|payments?|karte|kreditkarte|carte|tarjeta"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.7, 0.95, "(?:tele)?phones?|call|tel|mobile|fax|telefon|anruf|appel"),
)
ADDED = (
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])", None, 0.9, 0.99, "iban|accounts?|bank|konto|compte|cuenta"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.3, 0.8, "ssn|social security|taxpayer"),
)
#: Matches whose places are summed at once.
BLOCK = 256
#: Code points before and after a span in which its context words count.
CONTEXT = 40


def _luhn(digits: Column) -> Column:
    """Sum over the digits from the right, every second one doubled and 9 taken off above 9, divisible by 10."""
    doubled = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _mod97(iban: Column) -> Column:
    plain = F.replace(iban, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    step = lambda a, c: F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]?)"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.length(digits).between(13, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return _mod97(value)
    if kind == "ssn":
        return ~value.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def _running(items: Column, length, entry, kind: str) -> Column:
    """``entry(item, start)`` of each item, where start is the summed length of the items before it."""
    empty = F.array().cast(f"array<{kind}>")
    step = lambda a, p: F.struct((a["at"] + length(p)).alias("at"), F.concat(a["out"], F.array(entry(p, a["at"]))).alias("out"))
    return F.aggregate(items, F.struct(F.lit(0).alias("at"), empty.alias("out")), step)


def _placed(pairs: Column) -> Column:
    """Start, end, value and context of each match.  Sums run inside blocks and over blocks, as an
    array is copied whenever it grows."""
    kind = "struct<start:int,end:int,value:string,near:string>"
    entry = lambda p, at: F.struct((at + p["gap"]).alias("start"), (at + p["gap"] + p["length"]).alias("end"), p["value"].alias("value"), p["near"].alias("near"))
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor(F.size(pairs) / BLOCK).cast("int")),
        lambda b: _running(F.slice(pairs, b * BLOCK + 1, F.lit(BLOCK)), lambda p: p["gap"] + p["length"], entry, kind),
    )
    based = _running(blocks, lambda b: b["at"], lambda b, at: F.struct(at.alias("base"), b["out"].alias("out")), f"struct<base:int,out:array<{kind}>>")["out"]
    moved = lambda s, base: F.struct((s["start"] + base).alias("start"), (s["end"] + base).alias("end"), s["value"].alias("value"), s["near"].alias("near"))
    return F.flatten(F.transform(based, lambda b: F.transform(b["out"], lambda s: moved(s, b["base"]))))


def _matches(text: Column, kind: str, pattern: str, needs: str | None, *_) -> Column:
    """Array of (gap before, length, value, text around) of all matches; empty where none is possible."""
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    near = lambda g, after: F.lower(F.concat(F.right(g, F.lit(CONTEXT)), F.lit("\n"), F.left(after, F.lit(CONTEXT))))
    around = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), F.slice(gaps, F.lit(2), F.size(matches)), lambda g, after: F.struct(F.char_length(g).alias("gap"), near(g, after).alias("near")))
    pairs = F.zip_with(around, matches, lambda a, m: F.struct(a["gap"].alias("gap"), F.char_length(m).alias("length"), m.alias("value"), a["near"].alias("near")))
    possible = F.contains(text, F.lit(needs)) if needs else text.rlike("[0-9]")
    return F.when(possible, pairs).otherwise(F.array().cast("array<struct<gap:int,length:int,value:string,near:string>>"))


def _spans(pairs: Column, kind: str, pattern: str, needs: str | None, alone: float, near: float, words: str) -> Column:
    """Array of (kind, start, end, score) of the valid matches, in order of start."""
    valid = F.filter(_placed(pairs), lambda s: _valid(kind, s["value"]))
    score = lambda s: F.when(s["near"].rlike(rf"\b(?:{words})\b"), near).otherwise(alone)
    found = F.transform(valid, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), score(s).alias("score")))
    return F.when(F.size(pairs) > 0, found).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_score: float = 0.5) -> DataFrame:
    """(doc_id, base, added): arrays of (kind, start, end, score), by kind as listed above, then start."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Matches are columns of their own: what places them reads them more than once.
    matched = source.select("doc_id", *(_matches(F.col("text"), *rule).alias(f"{rule[0]}_matches") for rule in (*BASE, *ADDED)))
    by_kind = matched.select("doc_id", *(_spans(F.col(f"{rule[0]}_matches"), *rule).alias(rule[0]) for rule in (*BASE, *ADDED)))
    sure = [F.filter(rule[0], lambda s: s["score"] >= least_score) for rule in ADDED]
    return by_kind.select("doc_id", F.concat(*(rule[0] for rule in BASE)).alias("base"), F.concat(*sure).alias("added"))


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_score: float = 0.5) -> DataFrame:
    """One row per document: counts of the base kinds, the digest of the base spans, all spans and
    the highest score (null without spans)."""
    found = find_pii(docs, id_col, text_col, least_score)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    every = F.concat("base", "added")
    return found.select(
        "doc_id",
        *(count(rule[0]).alias(f"n_{rule[0]}") for rule in BASE),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(every).alias("spans"),
        F.array_max(F.transform(every, lambda s: s["score"])).alias("max_score"),
    )
