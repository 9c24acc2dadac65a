"""Personal data in texts: patterns propose spans, checks confirm them, words nearby adjust the score.

All work is in DataFrame expressions within the row of a text. The patterns are written so that matching takes time in
proportion to the text: runs are possessive, and a run is entered at its start or at the end of the previous match only.
Places are running sums by chunks and context is read from blocks of the text, so a text of many spans takes no longer a span.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.functions.rows import bind

CONTEXT_CHARS = 40  # so many characters before and after a span are searched for context words
ACCEPT = 0.5


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(number, i, F.lit(1)).cast("int")
        doubled = F.when(d >= 5, 2 * d - 9).otherwise(2 * d)
        return total + F.when((n - i) % 2 == 1, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account number (country, check digits, account) leaves 1 modulo 97."""
    turned = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, (rest * 100 + c - 55) % 97).otherwise((rest * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


@dataclass(frozen=True)
class Kind:
    """A kind of personal data.

    valid: a condition on the matched string. score, near and against: the score of a confirmed match, raised if a word
    of `near` and lowered if one of `against` (regular expressions over lower-case text) stands near it. `always`: kept
    whatever its score; of the other kinds the score decides.
    """

    name: str
    pattern: str
    valid: Callable[[Column], Column]
    score: float
    near: str
    against: str = r"\b(?:example|sample|version|invoice|order|isbn)\b"
    always: bool = False


_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"

KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         lambda h: F.lit(True), 0.9, r"\b(?:e-?mail|mail|contact|write)\b", always=True),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
         lambda h: h.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), 0.7, r"\b(?:ip|host|address|server|from)\b", always=True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){13,}+",
         lambda h: bind(digits(h), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(F.lit(False))),
         0.7, r"\b(?:card|visa|credit|payment|debit)\b", always=True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]",
         lambda h: F.length(digits(h)).between(10, 15), 0.7, r"\b(?:phone|tel|call|mobile|fax)\b", always=True),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
         lambda h: bind(F.regexp_replace(h, " ", ""), mod97), 0.6, r"\b(?:iban|account|bank|konto|compte)\b", r"\b(?:example|sample|version|isbn)\b"),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
         lambda h: F.lit(True), 0.3, r"\b(?:ssn|social security)\b"),
    Kind("secret", r"(?<![A-Za-z0-9_-])(?:[0-9a-f]{32,64}|[A-Za-z0-9_-]{40})(?![A-Za-z0-9_-])",
         lambda h: h.rlike("[0-9]") & h.rlike("[A-Za-z]"), 0.3, r"(?:token|secret|passw|credential|api.?key|auth|bearer|\bkey\b)"),
)
BASE_KINDS = ("email", "ip", "card", "phone")

SPAN = "array<struct<start:int,rank:int,end:int,kind:string,score:double>>"
CHUNK = 256  # values of a running result, or code points of a block of text, that are gone through one by one


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For every value (not negative) the result of `op` over all values before it, 0 before the first.

    An array that grows by one element a step is copied at every step, so results run within chunks, then over the
    totals of the chunks.
    """

    def within(part: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, start, lambda acc, v: F.struct(op(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))

    def over(v: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int")), lambda c: within(F.slice(v, c * CHUNK + 1, F.lit(CHUNK))))

        def joined(parts: Column) -> Column:
            bases = within(F.transform(parts, lambda p: p["at"]))
            return bind(bases, lambda base: F.flatten(F.transform(parts, lambda p, c: F.transform(p["out"], lambda x: op(F.get(base["out"], c), x)))))

        return F.when(F.size(v) > 0, bind(chunks, joined)).otherwise(F.array().cast("array<int>"))

    return bind(values, over)


def blocks_of(text: Column) -> Column:
    """The text in blocks of CHUNK code points, so that a place is found without walking there from the start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def between(blocks: Column, first: Column, end: Column) -> Column:
    """The text from code point `first` to `end`, exclusive; what lies behind the text is left out."""

    def of_block(at: Column) -> Column:
        n = F.floor((end - 1) / CHUNK).cast("int") - at + 1
        joined = F.array_join(F.slice(blocks, at + 1, n), "")
        return F.substring(joined, first - at * CHUNK + 1, end - first)

    return F.when(end > first, bind(F.floor(first / CHUNK).cast("int"), of_block)).otherwise(F.lit(""))


def _placed(text: Column, kind: Kind, rank: int) -> Column:
    """Confirmed spans of one kind. A match starts after the gaps and matches before it."""
    hits = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))

    def spans(found: Column) -> Column:
        gaps = F.transform(F.split(text, kind.pattern, -1), F.char_length)

        def walk(widths: Column) -> Column:
            taken = running(F.transform(found, lambda h, i: F.get(widths, i) + F.char_length(h)), lambda x, y: x + y)

            def place(before: Column) -> Column:
                def one(h: Column, i: Column) -> Column:
                    begin = F.get(before, i) + F.get(widths, i)
                    return F.struct(begin.alias("start"), (begin + F.char_length(h)).alias("end"), h.alias("hit"))

                return F.transform(found, one)

            return bind(taken, place)

        confirmed = F.filter(bind(gaps, walk), lambda s: F.coalesce(kind.valid(s["hit"]), F.lit(False)))

        def scored(s: Column, blocks: Column) -> Column:
            around = F.concat_ws("\n", between(blocks, F.greatest(s["start"] - CONTEXT_CHARS, F.lit(0)), s["start"]), between(blocks, s["end"], s["end"] + CONTEXT_CHARS))
            score = bind(F.lower(around), lambda b: F.lit(kind.score) + F.when(b.rlike(kind.near), 0.3).otherwise(0.0) - F.when(b.rlike(kind.against), 0.2).otherwise(0.0))
            return F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind.name).alias("kind"), F.round(score, 2).alias("score"))

        def all_scored(rows: Column) -> Column:
            return F.when(F.size(rows) > 0, bind(blocks_of(text), lambda blocks: F.transform(rows, lambda s: scored(s, blocks)))).otherwise(F.array().cast(SPAN))

        kept = bind(confirmed, all_scored)
        return kept if kind.always else F.filter(kept, lambda s: s["score"] >= ACCEPT)

    return bind(hits, lambda found: F.when(F.size(found) > 0, spans(found)).otherwise(F.array().cast(SPAN)))


def find_pii(docs: DataFrame, kinds: Sequence[Kind] = KINDS, text_col: str = "text", to: str = "pii_spans") -> DataFrame:
    """docs with an array of spans (start, rank, end, kind, score), by start and then by the order of `kinds`.

    Positions are code points from 0, the end exclusive. Matches of a kind are leftmost and do not overlap; a match that
    its check refuses is dropped without another try. Null and empty texts have no spans. Rows are kept as they are,
    repeated ones too; a column named like the result is replaced.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    spans = F.sort_array(F.concat(*(_placed(text, k, i) for i, k in enumerate(kinds))))
    return docs.select(*(F.col(f"`{c}`") for c in docs.columns if c != to), spans.alias(to))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scores_text(spans: Column) -> Column:
    """The score of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: s["score"].cast("string")), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redact(docs: DataFrame, kinds: Sequence[Kind] = KINDS, text_col: str = "text") -> DataFrame:
    """docs with every span in the text replaced by its kind in brackets; spans that overlap become one, named by the first.

    Texts without spans, null ones too, stay as they are.
    """
    found = find_pii(docs, kinds, text_col, "__spans")
    text, spans = F.col(f"`{text_col}`"), F.col("__spans")

    def replaced(reached: Column, blocks: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            new = F.concat(between(blocks, F.get(reached, i), s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
            return F.when(s["start"] >= F.get(reached, i), new).otherwise(F.lit(""))

        last = F.greatest(F.element_at(reached, -1), F.element_at(spans, -1)["end"])
        return F.concat(F.array_join(F.transform(spans, piece), ""), between(blocks, last, F.char_length(text)))

    reached = running(F.transform(spans, lambda s: s["end"]), F.greatest)  # the end of all spans before a span
    new = F.when(F.size(spans) > 0, bind(reached, lambda r: bind(blocks_of(text), lambda b: replaced(r, b)))).otherwise(text)
    return found.select(*(new.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))
