"""Native operators against plain Python: quality rules and personal data."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import as_set
from threadloom.llm import pii, quality_rules

BLANK = re.compile(r"[\x20\x09-\x0D]+")


def plain_words(text):
    return [w for w in BLANK.split(text or "") if w]


def plain_measures(text):
    text = text or ""
    words = plain_words(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if plain_words(x)]
    n = len(words)
    return (
        n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated),
        n < 20 or 100 * len(repeated) > 30 * n,
    )


MEASURED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


@pytest.mark.parametrize("which", ["edge", "documents"])
def test_base_counts(which, request, labels):
    docs = request.getfixturevalue(which)
    rows = quality_rules.judged(docs, labels.where("quality = 1").select("doc_id")).select("doc.text", *MEASURED).collect()
    assert len(rows) == docs.count()
    for row in rows:
        assert tuple(row)[1:] == plain_measures(row.text), row.text


def test_overlapping_windows(spark):
    texts = ["a " * 9, "a b " * 8, " ".join(map(str, range(12))) + " " + " ".join(map(str, range(3, 12))), "a b c d e f g h i", "q " * 7]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = quality_rules.measures(quality_rules.with_words(docs)).select("text", *MEASURED).collect()
    for row in rows:
        assert tuple(row)[1:] == plain_measures(row.text), row.text


def test_ratios_and_verdict(spark, documents, labels):
    trusted = labels.where("quality = 1").select("doc_id")
    good = {r.doc_id for r in trusted.collect()}
    rows = documents.select("doc_id", "text").collect()
    grams = {}  # the hash of each word and edge, from Spark

    def pieces(text):
        return [p for w in plain_words(text) for p in ((w, 0), (w[:3], 1), (w[-3:], 2))]

    every = sorted({p for r in rows for p in pieces(r.text)})
    df = spark.createDataFrame(every, "w string, mark int")
    code = F.when(F.col("mark") == 0, F.xxhash64("w")).otherwise(F.xxhash64("w", "mark"))
    for r in df.select("w", "mark", F.pmod(code, F.lit(quality_rules.BUCKETS)).alias("b")).collect():
        grams[r.w, r.mark] = r.b
    raw, kept = Counter(), Counter()
    for r in rows:
        own = Counter(grams[p] for p in pieces(r.text))
        raw += own
        if r.doc_id in good:
            kept += own
    scale, s = sum(raw.values()) / sum(kept.values()), quality_rules.SMOOTHING
    stutters = {r.doc_id: sum(a == b for a, b in zip(plain_words(r.text), plain_words(r.text)[1:])) for r in rows}
    all_same, good_same = sum(stutters.values()), sum(n for i, n in stutters.items() if i in good)
    same = math.log((good_same * scale + s) / (max(all_same - 1, 0) + s))
    unlike = math.log(((sum(kept.values()) / 3 - good_same) * scale + s) / (sum(raw.values()) / 3 - all_same + s))
    ratio = {b: math.log((kept[b] * scale + s) / (max(raw[b] - 1, 0) + s)) for b in raw}
    found = {r.doc_id: r for r in quality_rules.judged(documents, trusted).select("doc.doc_id", "llr", "kept", "base_failed").collect()}
    for r in rows:
        values = [ratio[grams[p]] for p in pieces(r.text)]
        n, own = len(values) / 3, stutters[r.doc_id]
        llr = sum(values) / len(values) + (own * same + (n - own) * unlike) / n if values else 0.0
        assert math.isclose(found[r.doc_id].llr, llr, abs_tol=1e-9)
        assert found[r.doc_id].kept == (not found[r.doc_id].base_failed and llr >= quality_rules.THRESHOLD)


def test_good_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    kept = quality_rules.keep_good(docs, labels.where("quality = 1").select("doc_id"))
    assert kept.columns == docs.columns
    by = {r.quality: r for r in quality_rules.judged(docs, labels.where("quality = 1").select("doc_id")).select(
        "doc.doc_id", "kept", "base_failed").join(labels, "doc_id").groupBy("quality").agg(
        F.avg((F.col("kept") | F.col("base_failed")).cast("int")).alias("stays"), F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert by[1].stays == 1.0
    assert by[0].kept < 0.1


def test_without_trusted_documents_only_the_base_rules_decide(edge, labels):
    rows = quality_rules.judged(edge, labels.where("false").select("doc_id")).select("base_failed", "kept", "llr").collect()
    assert all(r.kept != r.base_failed and r.llr == 0.0 for r in rows)


def plain_luhn(m):
    d = [int(c) for c in re.sub("[^0-9]", "", m)][::-1]
    return 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", plain_luhn),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= sum(c.isdigit() for c in m) <= 15),
}


def plain_base(text):
    found = [
        (m.start(), n, m.end(), kind)
        for n, (kind, (pattern, valid)) in enumerate(PLAIN.items())
        for m in re.finditer(pattern, text or "")
        if valid(m[0])
    ]
    return ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in sorted(found))


TRICKY = [
    "a@b.c%d@e.f x.y@z", "1.2.3.4.5.6.7.8 0001.002.3.255 256.1.1.1 1.2.3", "+1 (555) 010-9999) +12 3", "++49 1 2 3 4 5 6 7 8 9",
    "4111-1111-1111-1111 4111 1111 1111 1112 4111  1111", "\U0001f600\U0001f600 me@x.org 10.0.0.1", "@@a@b@c.d", "9" * 200, "1." * 300,
    " ".join(f"u{i}@h{i}.org 10.0.{i % 300}.1" for i in range(600)), "é@ü.de a@b.", "5500005555555559 5500005555555558",
]


@pytest.mark.parametrize("which", ["edge", "documents", "tricky"])
def test_personal_data(which, request, spark):
    docs = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string") if which == "tricky" else request.getfixturevalue(which)
    rows = pii.reported(docs).select("doc.text", "*").collect()
    assert len(rows) == docs.count()
    for row in rows:
        expected = plain_base(row["text"])
        assert row.base_sha256 == hashlib.sha256(expected.encode()).hexdigest(), row["text"]
        kinds = Counter(x.split(":")[0] for x in expected.split(",") if x)
        assert [row[f"n_{k}"] for k in PLAIN] == [kinds[k] for k in PLAIN]
        assert ",".join(x for x in row.spans.split(",") if x.split(":")[0] in PLAIN) == expected


def test_added_kinds_need_checksum_and_context(spark):
    texts = ["pay to IBAN DE89 3704 0044 0532 0130 00 now", "IBAN DE88 3704 0044 0532 0130 00", "my SSN 123-45-6789", "part 123-45-6789"]
    rows = pii.reported(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc.doc_id", "n_iban", "n_ssn", "spans").collect()
    found = {r.doc_id: (r.n_iban, r.n_ssn) for r in rows}
    assert found == {0: (1, 0), 1: (0, 0), 2: (0, 1), 3: (0, 0)}


def test_redaction(spark, edge):
    docs = spark.createDataFrame([(1, "mail a@b.co or 10.1.2.3, call +1 555 010 9999 x", 3)], "doc_id long, text string, n_chars long")
    assert as_set(pii.redacted(docs)) == [(1, "mail [EMAIL] or [IP], call [PHONE] x", 36)]
    assert pii.redacted(edge).columns == edge.columns
    left = pii.reported(pii.redacted(edge)).agg(*[F.sum(f"n_{k}") for k in PLAIN]).first()
    assert set(left) == {0}


def test_empty_tables(empty, labels):
    assert pii.reported(empty).count() == pii.redacted(empty).count() == 0
    assert quality_rules.judged(empty, labels.where("quality = 1").select("doc_id")).count() == 0
