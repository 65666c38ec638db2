"""Periodic runs against a comparison of every period, pieces against the public library, phrases against plain counts and SQL."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st

import __spark_entry__
import check
from tests.llm.conftest import SF
from threadloom.llm import collocations, periodic_runs, pieces
from threadloom.llm.words import public_path


def plain_runs(words):
    n, least = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - s >= max(6, 4 * q):
                least.setdefault((s, i + q), q)
    return sorted(((s, e, q) for (s, e), q in least.items()), key=lambda r: (r[0], r[2]))


def stammering(rnd):
    """Few words, stretches repeated up to seven times, repeats of repeats."""
    k, n, words = rnd.randint(1, 4), rnd.randint(0, 400), []
    while len(words) < n:
        draw = rnd.random()
        if draw < 0.3:
            words += [rnd.randint(0, k) for _ in range(rnd.randint(1, 20))]
        elif draw < 0.8:
            unit = [rnd.randint(0, k) for _ in range(rnd.randint(1, 60))]
            words += (unit * rnd.randint(2, 7))[: rnd.randint(1, 400)]
        else:
            at = rnd.randint(0, len(words))
            words += words[at : at + rnd.randint(1, 30)] * rnd.randint(1, 5)
    return words


@settings(max_examples=300, deadline=None)
@given(st.randoms(use_true_random=False))
def test_runs_of_any_words(rnd):
    words = stammering(rnd)
    assert periodic_runs.runs(np.array(words, np.int64)) == plain_runs(words)


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


NESTED = [
    fibonacci(2000), ([0] * 50 + [1]) * 12, (([0] * 9 + [1]) * 5 + [2]) * 6, ([0, 1] * 40 + [2]) * 9,
    (([0, 0, 1] * 8 + [3]) * 6 + [4]) * 5, [0] * 500, [0, 1] * 3, [0] * 5, [0] * 6, [], [7],
]


@pytest.mark.parametrize("words", NESTED, ids=lambda w: f"{len(w)}-{len(set(w))}")
def test_nested_repeats(words):
    assert periodic_runs.runs(np.array(words, np.int64)) == plain_runs(words)


def test_texts_of_a_block_do_not_meet():
    rnd = random.Random(4)
    texts = [[b"%d" % w for w in stammering(rnd)] if i % 5 else [] for i in range(60)] + [[b"a"] * 3, [b"a"] * 5]
    assert periodic_runs.block_runs(texts) == [plain_runs(t) for t in texts]


def test_a_very_long_text():
    words = np.random.default_rng(1).integers(0, 5, 400_000)
    words[1000:300_000] = np.resize(words[1000:31_000], 299_000)
    found = [r for r in periodic_runs.runs(words) if r[2] > 100]
    assert len(found) == 1 and found[0][2] == 30_000 and found[0][0] <= 1000 and found[0][1] >= 300_000


def plain_digests(doc_id, text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = plain_runs(words)
    best = min(found, key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2]), default=None)
    gone = {i for s, e, q in found for i in range(s + q, e)}
    strongest = (None,) * 4 if best is None else (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2])
    listed = "".join(f"{s},{e - s},{q}\n" for s, e, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *strongest, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


@pytest.mark.parametrize("block", [50, periodic_runs.WORDS_PER_BLOCK])
def test_digests_of_runs(spark, edge, block):
    rnd = random.Random(9)
    made = [(i, " \t".join(f"w{w}" for w in stammering(rnd))) for i in range(60)]
    for docs in (edge, spark.createDataFrame(made, "doc_id long, text string")):
        found = periodic_runs.run_digests(docs, block).collect()
        expected = [plain_digests(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, expected))
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in made)


def test_documents_and_empty_table(documents, empty):
    short = documents.where("length(text) < 6000")
    found = periodic_runs.run_digests(short).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(repr(plain_digests(r.doc_id, r.text)) for r in short.collect())
    assert periodic_runs.run_digests(empty).count() == periodic_runs.periodic_runs(empty).count() == 0


def test_listed_runs(spark):
    docs = spark.createDataFrame([(1, "x " + "a b " * 5 + "y"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: (list(map(tuple, r.runs)), r.collapsed) for r in periodic_runs.periodic_runs(docs).collect()}
    assert rows == {1: ([(1, 10, 2)], "x a b y"), 2: ([], "")}


TEXTS = st.text(
    st.one_of(st.sampled_from("abcdefghTHE   \n\t\x00\x1c\x85\xa0\u3000▁!?#.é\u0301ßı中文Ⅷ\u200d\U0001f600⁇<s>0xＡｶﾞ①ﬁ"), st.characters(codec="utf-8")),
    max_size=60,
)


@pytest.fixture(scope="module")
def piece_library():
    return sentencepiece.SentencePieceProcessor(model_file=public_path(pieces.MODEL))


@pytest.fixture(scope="module")
def piece_model():
    return pieces.model(public_path(pieces.MODEL))


def byte_places(text):
    return np.concatenate([[0], np.cumsum([len(c.encode()) for c in text], dtype=int)])


def check_pieces(library, own, text):
    ids, spans, decoded = own.encode(text)
    expected = library.encode(text, add_bos=True, add_eos=True)
    assert np.frombuffer(ids, "<u4").tolist() == expected
    assert decoded.decode() == library.decode(expected) == own.decode(expected)
    proto = library.encode(text, return_type="proto")
    size = len(text.encode())
    assert list(map(tuple, spans.tolist())) == [(0, 0), *[(p.begin, p.end) for p in proto.pieces], (size, size)]


@settings(max_examples=500, deadline=None)
@given(TEXTS)
def test_any_text_becomes_the_pieces_of_the_library(piece_library, piece_model, text):
    check_pieces(piece_library, piece_model, text)


@pytest.mark.parametrize("text", ["", " ", "▁", "a" * 100_000, " " * 100_000, "ab" * 3000 + " " * 17 + "x", "\n" * 5000, "中" * 5000, "Ⅷ" * 5000, "aé" * 20_000])
def test_long_stretches(piece_library, piece_model, text):
    check_pieces(piece_library, piece_model, text)


def test_both_ways_of_merging_agree(piece_model):
    rnd = random.Random(2)
    for _ in range(300):
        text = "".join(rnd.choice("▁aeinrst") for _ in range(rnd.randint(1, 120)))
        assert piece_model.merged(list(text)) == piece_model.merged_long(list(text))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([0, 1, 2, 259, 28705]), st.integers(3, 258), st.integers(259, 31999)), max_size=10))
def test_any_ids_are_decoded_as_the_library_does(piece_library, piece_model, ids):
    assert piece_model.decode(ids) == piece_library.decode(ids)


@pytest.mark.parametrize("rule", ["identity", "nfkc", "nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("prefix", [False, True])
@pytest.mark.parametrize("trim", [False, True])
def test_compiled_character_maps(rule, prefix, trim):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=prefix, escape_whitespaces=True, remove_extra_whitespaces=trim)
    own = object.__new__(pieces.Model)
    own.map = pieces.CharacterMap(dict(pieces.fields(library.serialized_normalizer_spec())).get(pieces.CHARACTER_MAP, b""))
    own.prefix, own.trim = prefix, trim
    rnd = random.Random(5)
    letters = "abT  \n\t\x00\x1c\x85\xa0\u3000▁▁!é\u0301ßı中Ⅷ\u200d\U0001f600ＡＢｶﾞ①ﬁ½Å\u2003㌀가각\u0323각"
    for _ in range(500):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 25)))
        normal, align = own.normalised(text)
        expected, offsets = library.normalize(text, with_offsets=True)
        assert normal == expected
        # The library's offsets count characters.
        found = np.searchsorted(byte_places(text), align[byte_places(normal)], side="right") - 1
        assert found.tolist() == list(offsets)


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        pieces.Model(b"")


def test_digests_of_pieces(edge, documents, empty, piece_library):
    for docs in (edge, documents, empty):
        expected = []
        for r in docs.select("doc_id", "text").collect():
            ids = piece_library.encode(r.text or "", add_bos=True, add_eos=True)
            digests = [np.array(ids, "<u4").tobytes(), piece_library.decode(ids).encode()]
            expected.append((r.doc_id, len(ids), *[hashlib.sha256(d).hexdigest() for d in digests]))
        found = [tuple(r)[:4] for r in pieces.digests(docs).collect()]
        assert sorted(map(repr, found)) == sorted(map(repr, expected))


def test_spans_point_at_the_source(edge, empty):
    assert pieces.encoded(empty).count() == 0
    texts = edge.select("text").collect()
    for r, t in zip(pieces.encoded(edge).collect(), texts):
        source = (t.text or "").encode()
        assert b"".join(source[a:b] for a, b in zip(r.starts, r.ends)) == source
        assert r.decoded == (t.text or "").replace("▁", " ")


def plain_collocations(rows, top, least):
    """By counting every phrase of one to four words by itself."""
    counts: dict[str, Counter] = {}
    for lang, text in rows:
        own = counts.setdefault(lang or "und", Counter())
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            for n in range(1, 5):
                own.update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, own in counts.items():
        total, found = sum(f for w, f in own.items() if len(w) == 1), []
        long = [(w, f) for w, f in own.items() if len(w) > 2 and f >= least]
        for words, a in own.items():
            if len(words) < 2 or a < least:
                continue
            inside = any(len(w) > len(words) and 100 * f >= 80 * a and any(w[i : i + len(words)] == words for i in range(len(w))) for w, f in long)
            if not inside:
                score, _, left, right = min((2_000_000 * a // (own[words[:k]] + own[words[k:]]), k, own[words[:k]], own[words[k:]]) for k in range(1, len(words)))
                found.append((-score, -a, " ".join(words).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total, -score))
    return sorted(out)


@pytest.mark.parametrize("least,top", [(2, 5), (3, 2000)])
def test_phrases_by_plain_counts(spark, edge, least, top):
    rnd = random.Random(6)
    texts = [("de" if i % 3 else None, "".join(rnd.choice(["a", "B", "é", "c d", "-", "q\t", "\U0001f600"]) + rnd.choice([" ", " ", " ", "  ", ". ", ",", "\n"]) for _ in range(60))) for i in range(40)]
    made = spark.createDataFrame(texts + [(None, None), ("fr", ""), ("fr", ".;:")], "lang string, text string")
    for docs in (made, edge):
        expected = plain_collocations(docs.select("lang", "text").collect(), top, least)
        assert sorted(map(tuple, collocations.collocations(docs, top, least).collect())) == expected
        assert expected


@pytest.mark.parametrize("bits,block_words", [(8, 100), (27, 7)])
def test_a_small_sieve_and_small_blocks_change_nothing(documents, bits, block_words):
    """With 256 bits nearly all pairs and triples pass; texts are never cut, whatever the block."""
    docs = documents.where("length(text) < 3000")
    blocks = collocations.word_blocks(docs, block_words)
    tables = collocations.sieve(blocks, 5, bits)
    assert [len(t) * 8 for t in tables] == [1 << bits] * 2
    found = collocations.frequencies(collocations.lead_windows(blocks, tables), least=5)
    counts = Counter()
    for r in docs.collect():
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            counts.update((r.lang or "und", tuple(words[i : i + n])) for n in range(1, 5) for i in range(len(words) - n + 1))
    expected = {key: f for key, f in counts.items() if f >= 5}
    assert {(r.lang, tuple(r.words)): r.f for r in found.where("size(words) > 0").collect()} == expected


def test_windows_of_many_words_are_counted_apart():
    """Numbers so big that four of them don't fit 64 bits."""
    rnd = np.random.default_rng(3)
    numbers = np.append(rnd.choice([0, 1, 10**6, 3 * 10**8, -1], 4000), -1)
    reach, open_still = [], numbers >= 0
    for _ in range(3):
        both = np.zeros(len(numbers), bool)
        both[:-1] = open_still[:-1] & open_still[1:]
        both &= rnd.random(len(numbers)) < 0.9
        reach.append(both)
        open_still = both
    columns, counts = collocations.counted_windows(numbers, reach)
    found = dict(zip(zip(*[c.tolist() for c in columns]), counts.tolist()))
    expected = Counter()
    for i in np.flatnonzero(numbers >= 0).tolist():
        n = 1 + next((k for k, r in enumerate(reach) if not r[i]), 3)
        expected[tuple(numbers[i : i + n].tolist()) + (-1,) * (4 - n)] += 1
    assert found == expected


def test_windows_of_a_block_are_sent_in_small_batches(monkeypatch):
    held = collocations.Writing()
    held.add("de", b"a b c d a e. b c f, g h i j k a b")
    held.add("fr", b"a b c d; b c f g h i a")
    numbers, words, langs, names = held.row().columns
    block = collocations.Block(numbers[0].as_py(), words.values, langs[0].as_py(), names[0].as_py())
    (whole,) = collocations.window_batches(block, [])
    monkeypatch.setattr(collocations, "SENT_WINDOWS", 7)
    some = list(collocations.window_batches(block, []))
    assert len(some) > 2 and max(batch.num_rows for batch in some) <= 7
    assert [row for batch in some for row in batch.to_pylist()] == whole.to_pylist()


def test_phrases_agree_with_sql(spark):
    found = __spark_entry__.queries()["op11_collocations"](spark, SF)
    assert check.compare(check.connect(SF), found, collocations.SQL) == ""


def test_phrases_of_an_empty_table(empty):
    found = collocations.collocations(empty)
    assert found.count() == 0 and found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_phrase_arithmetic_passes_64_bits(spark):
    big = 3 * 10**15
    rows = [("en", ["a"], big), ("en", ["b"], big + 1), ("en", ["a", "b"], big - 1), ("en", [], 10 * big)]
    phrases = spark.createDataFrame(rows, "lang string, words array<string>, f long")
    (row,) = collocations.scored(phrases).collect()
    assert (row.a, row.l, row.r, row.score) == (big - 1, big, big + 1, 2_000_000 * (big - 1) // (2 * big + 1))
