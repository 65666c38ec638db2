"""Personal data: patterns propose spans, checksums confirm them, words before them adjust the score.

DataFrame functions only. The matches of a pattern and the text between them
come from the same regular expression; running sums of their lengths give the
places, counted in code points. A proposal that its validator turns down is
dropped. Each span has a score: its kind's, more if a word that goes with the
kind stands shortly before it. Spans of the base kinds stay whatever their
score; those of the other kinds need ``MIN_SCORE``.

Null and empty texts have no spans. Repeated rows get equal results. Patterns
never go back over what they have read, so long runs take linear time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from threadloom.llm.common import let, packed, unpacked, whole_text

MIN_SCORE = 0.5
CONTEXT_BONUS = 0.3
# Code points before a span that are searched for context words.
CONTEXT_CHARS = 40
BLOCK = 256

SPAN = "array<struct<start:int,kind:int,end:int,score:double>>"


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def digit_count_between(low: int, high: int):
    return lambda match: F.length(digits(match)).between(low, high)


def small_parts(match: Column) -> Column:
    """All parts between dots are at most 255, leading zeros aside."""
    number = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.forall(
        F.split(match, r"\."), lambda p: let(number(p), lambda n: (F.length(n) <= 3) & (F.lpad(n, 3, "0") <= "255"))
    )


def luhn(match: Column) -> Column:
    """14 to 19 digits whose Luhn sum is a multiple of ten."""

    def total(number: Column) -> Column:
        doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        digit = lambda i: number.substr(i, F.lit(1)).cast("int")
        places = F.sequence(F.lit(1), F.length(number))
        return F.aggregate(
            places, F.lit(0), lambda s, i: s + F.when(i % 2 == 0, doubled(digit(i))).otherwise(digit(i))
        )

    return let(
        F.reverse(digits(match)),
        lambda number: F.when(F.length(number).between(14, 19), total(number) % 10 == 0).otherwise(F.lit(False)),
    )


def mod97(match: Column) -> Column:
    """The account number's check: letters count from 10, the first four characters go last, remainder 1."""
    turned = lambda s: F.concat(s.substr(F.lit(5), F.length(s)), s.substr(F.lit(1), F.lit(4)))
    step = lambda rest, c: F.when(
        c >= "A", (rest * 100 + F.ascii(c) - 55) % 97
    ).otherwise((rest * 10 + F.ascii(c) - 48) % 97)
    return let(
        turned(F.replace(match, F.lit(" "), F.lit(""))),
        lambda s: F.aggregate(
            F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: s.substr(i, F.lit(1))), F.lit(0), step
        )
        == 1,
    )


@dataclass(frozen=True)
class Kind:
    name: str
    # Found in every text that has a match; spares the others the search.
    guard: str
    pattern: str
    score: float
    context: str
    valid: object = None
    base: bool = True


# In these patterns, (?<!x) with \G starts a run once, and possessive repeats never give back.
KINDS = (
    Kind(
        "email", "@",
        r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        0.8, "mail|contact|write|reach",
    ),
    Kind(
        "ip", r"[0-9]\.[0-9]",
        r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        0.6, r"\bip\b|server|host|address|login", small_parts,
    ),
    Kind(
        "card", r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]",
        r"[0-9](?:[ -]?[0-9])++",
        0.7, "card|visa|credit|debit|pay", luhn,
    ),
    Kind(
        "phone", r"\+[0-9]",
        r"\+[0-9][ ().0-9-]+[0-9]",
        0.6, r"phone|call|\btel|mobile|fax", digit_count_between(10, 15),
    ),
    Kind(
        "iban", "[A-Z]{2}[0-9]{2}",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])",
        0.7, "iban|account|bank|transfer|konto|cuenta|compte", mod97, False,
    ),
    Kind(
        "ssn", "[0-9]{3}-[0-9]{2}-[0-9]{4}",
        r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        0.3, r"\bssn\b|social security|tax", None, False,
    ),
)


def running_sums(values: Column) -> Column:
    """Sums up to and including each value; in blocks, so that long arrays take little more than linear time."""

    def sums(part: Column, start: Column) -> Column:
        state = F.struct(start.alias("sum"), F.array().cast("array<int>").alias("sums"))
        step = lambda s, x: F.struct(
            (s["sum"] + x).alias("sum"), F.concat(s["sums"], F.array(s["sum"] + x)).alias("sums")
        )
        return F.aggregate(part, state, step, lambda s: s["sums"])

    blocks = F.transform(
        F.sequence(F.lit(1), F.size(values), F.lit(BLOCK)), lambda at: F.slice(values, at, F.lit(BLOCK))
    )
    total = lambda part: F.aggregate(part, F.lit(0), lambda s, x: s + x)
    starts = lambda parts: F.concat(F.array(F.lit(0)), sums(F.transform(parts, total), F.lit(0)))
    return let(
        blocks,
        lambda parts: let(
            starts(parts), lambda at: F.flatten(F.transform(parts, lambda part, i: sums(part, F.get(at, i))))
        ),
    )


def accepted(match: Column, score: Column, kind: Kind) -> Column:
    valid = kind.valid(match) if kind.valid else F.lit(True)
    return valid if kind.base else valid & (score >= MIN_SCORE)


def score_of(before: Column, kind: Kind) -> Column:
    near = F.lower(F.right(before, F.lit(CONTEXT_CHARS))).rlike(kind.context)
    return F.least(F.lit(1.0), F.lit(kind.score) + F.when(near, F.lit(CONTEXT_BONUS)).otherwise(F.lit(0.0)))


def spans_of(text: Column, number: int, kind: Kind) -> Column:
    """The accepted spans of one kind, ordered by place."""
    none = F.array().cast(SPAN)

    def placed(matches: Column, gaps: Column) -> Column:
        steps = F.transform(
            matches, lambda m, i: F.length(F.get(gaps, i)) + F.coalesce(F.length(F.get(matches, i - 1)), F.lit(0))
        )

        def span(m: Column, i: Column, starts: Column) -> Column:
            score = score_of(F.get(gaps, i), kind)
            at = F.struct(
                F.get(starts, i).alias("start"),
                F.lit(number).alias("kind"),
                (F.get(starts, i) + F.length(m)).alias("end"),
                score.alias("score"),
            )
            return F.when(accepted(m, score, kind), at)

        return let(
            running_sums(steps),
            lambda starts: F.filter(
                F.transform(matches, lambda m, i: span(m, i, starts)), lambda x: x.isNotNull()
            ).cast(SPAN),
        )

    searched = let(
        F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)),
        lambda m: F.when(F.size(m) == 0, none).otherwise(
            let(F.split(text, kind.pattern, -1), lambda gaps: placed(m, gaps))
        ),
    )
    return F.when(text.rlike(kind.guard), searched).otherwise(none)


def written(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )


def with_spans(docs: DataFrame) -> DataFrame:
    """``doc`` (all columns), the ``spans`` of each base kind in a column ``of_<kind>``, and all ``spans`` in order."""
    df = packed(docs).withColumn("text", whole_text("doc.text"))
    df = df.select("doc", *[spans_of(F.col("text"), i, k).alias(f"of_{k.name}") for i, k in enumerate(KINDS)])
    every = [F.col(f"of_{k.name}") for k in KINDS]
    return df.select("*", F.array_sort(F.concat(*every)).alias("spans"))


def reported(docs: DataFrame) -> DataFrame:
    """Counts by base kind, the digest of the base spans, all spans and their scores."""
    df = with_spans(docs)
    base = F.filter("spans", lambda s: s["kind"] < sum(k.base for k in KINDS))
    return df.select(
        "doc",
        *[F.size(f"of_{k.name}").cast("long").alias(f"n_{k.name}") for k in KINDS],
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: s["score"].cast("decimal(3,2)").cast("string")), ",").alias(
            "scores"
        ),
    )


def redacted_text(text: Column, kind: Kind) -> Column:
    """The text with accepted spans of one kind replaced by the kind's name."""

    def pieces(matches: Column, gaps: Column) -> Column:
        return F.transform(
            gaps,
            lambda gap, i: F.concat(
                gap,
                let(
                    F.coalesce(F.get(matches, i), F.lit("")),
                    lambda m: F.when(
                        (m != "") & accepted(m, score_of(gap, kind), kind), F.lit(f"[{kind.name.upper()}]")
                    ).otherwise(m),
                ),
            ),
        )

    searched = let(
        F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)),
        lambda m: F.when(F.size(m) == 0, text).otherwise(
            let(F.split(text, kind.pattern, -1), lambda gaps: F.array_join(pieces(m, gaps), ""))
        ),
    )
    return F.when(text.rlike(kind.guard), searched).otherwise(text)


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with personal data replaced, kind by kind; null texts stay null, ``n_chars`` follows the text.

    A kind is looked for in the text that the kinds before it have left, so where spans of several kinds overlap in
    ``reported``, the first kind's is replaced and what remains of the others is judged anew.
    """
    df = packed(docs).withColumn("text", F.col("doc.text"))
    for kind in KINDS:
        df = df.withColumn("text", redacted_text(F.col("text"), kind))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return unpacked(df, docs.columns, **changed)
