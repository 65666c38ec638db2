"""Near-duplicates, lines, components and fingerprints against brute force."""

from __future__ import annotations

import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tests.llm.conftest import as_set
from threadloom.llm import components, fingerprints, line_dedup, simhash


def union_find(nodes, edges):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("kind", ["chain", "star", "random", "loops", "none"])
def test_components(spark, kind, monkeypatch):
    rnd = random.Random(1)
    edges = {
        "chain": [(i, i + 1) for i in range(70)], "star": [(500, i) for i in range(90)],
        "random": [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(220)],
        "loops": [(5, 5), (7, 8), (8, 7), (7, 8), (None, 3)], "none": [],
    }[kind]
    monkeypatch.setattr(components, "EDGES_PER_CHUNK", 16)
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    found = {r.node: r.root for r in components.components(df).collect()}
    known = [(a, b) for a, b in edges if a is not None and b is not None]
    assert found == union_find({n for e in known for n in e}, known)


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def close(a, b):
    return (a ^ b).bit_count() <= 3


@pytest.mark.parametrize("which", ["edge", "documents", "empty"])
def test_near_duplicates(which, request):
    docs = request.getfixturevalue(which)
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.select("doc_id", "text").collect()]
    fps = sorted({f for _, f in rows})
    root = union_find(fps, [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if close(a, b)])
    low = {}
    for doc_id, f in rows:
        if doc_id is not None:
            low[root[f]] = min(doc_id, low.get(root[f], doc_id))
    expected = sorted(((d, f"{f:016x}", low.get(root[f])) for d, f in rows), key=repr)
    assert as_set(simhash.near_duplicates(docs)) == expected


def test_every_link_of_up_to_three_bits_is_found(spark):
    rnd = random.Random(3)
    centres = [rnd.getrandbits(64) for _ in range(600)]
    fps, edges = set(centres), []
    for c in centres:
        for n in (1, 2, 3, 4):
            other = c ^ sum(1 << b for b in rnd.sample(range(64), n))
            fps.add(other)
    hub = rnd.getrandbits(64)  # a close group that fills its buckets
    fps |= {hub ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20)}
    fps = sorted(fps)
    bits = np.array(fps, dtype=np.uint64)
    for i, a in enumerate(bits):
        edges += [(fps[i], fps[j]) for j in np.flatnonzero(np.bitwise_count(bits[i + 1 :] ^ a) <= 3) + i + 1]
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long").repartition(6)
    found = simhash.links(df).collect()
    assert len(found) < 40 * len(fps)
    mine = union_find(fps, [(r.a % 2**64, r.b % 2**64) for r in found])
    assert mine == union_find(fps, edges)


def test_a_long_run_is_never_searched_whole(monkeypatch):
    rnd = np.random.default_rng(4)
    fps = rnd.integers(0, 1 << 41, 5_000, dtype=np.uint64)  # one exact segment, else far apart
    flips = np.uint64(1) << rnd.integers(0, 41, (3, 2_000)).astype(np.uint64)
    fps = np.unique(np.concatenate([fps, fps[:2_000] ^ flips[0] ^ flips[1] ^ flips[2]]))
    sizes, plain = [], simhash.forest
    monkeypatch.setattr(simhash, "forest", lambda x: sizes.append(len(x)) or plain(x))
    found = np.concatenate(simhash.linked(np.zeros(len(fps), np.int64), fps), axis=1).T.tolist()
    assert max(sizes, default=0) < 200
    nodes = fps.tolist()
    assert union_find(nodes, found) == union_find(nodes, plain(fps))


def test_one_of_each_group_stays(spark, edge):
    kept = simhash.keep_first(edge)
    assert kept.columns == edge.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 5, 7, 8, 9, 9, 10, 11, 12, 13, 14]
    assert ids.count(None) == 2


def test_codewords_are_at_least_seven_bits_apart_and_cover_all():
    errors, offsets, _ = simhash.golay()
    assert np.bincount(np.bitwise_count(errors)).tolist() == [1, 23, 253, 1771]
    values = np.random.default_rng(0).integers(0, 1 << 23, 2000)
    for a in values[:300]:
        for n in (1, 2):
            b = a ^ sum(1 << x for x in random.Random(int(a)).sample(range(23), n))
            keys = simhash.segment_keys(np.array([a, b]))
            assert set(keys[0]) & set(keys[1])


def plain_lines(rows):
    """Kept line numbers by document, from all pairs of lines."""
    places = {}
    for doc_id, text in rows:
        for n, raw in enumerate((text or "").encode().split(b"\n")):
            line = raw.strip().lower().decode()
            if line:
                places.setdefault(line, set()).add((doc_id is None, doc_id if doc_id is not None else 0, text, n))
    lines = sorted(places)
    grams = {x: line_dedup.shingles(x) for x in lines}
    pairs = [
        (a, b) for i, a in enumerate(lines) for b in lines[i + 1 :]
        if min(len(grams[a]), len(grams[b])) >= 0.8 * max(len(grams[a]), len(grams[b]))
        and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])
    ]
    return places, union_find(lines, pairs)


@pytest.mark.parametrize("which", ["edge", "documents", "empty"])
def test_line_dedup(which, request):
    docs = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    places, root = plain_lines(rows)
    found = {}
    for r in line_dedup.decisions(docs).collect():
        found[r.doc_id, r.text_hash] = (r.n_lines, set(r.removed))
    assert sum(n for n, _ in found.values()) == sum(map(len, places.values()))
    groups = {}
    for line, own in places.items():
        groups.setdefault(root[line], set()).update(own)
    assert sum(len(x) for _, x in found.values()) == sum(len(g) - 1 for g in groups.values())
    out = line_dedup.removed_lines(docs)
    assert out.count() == len(rows)
    kept = line_dedup.without_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    texts = kept.select("text", "n_chars").collect()
    left = [x.strip().lower() for r in texts for x in (r.text or "").encode().split(b"\n") if x.strip()]
    assert len(set(left)) == len(groups)
    assert all(r.n_chars == len(r.text) for r in texts if r.text is not None)


def test_close_group_of_lines_falls_to_one(spark):
    rnd = random.Random(5)
    base = [f"w{rnd.randint(0, 9999)}" for _ in range(80)]
    texts = []
    for i in range(60):
        words = list(base)
        words[rnd.randint(0, 79)] = f"x{i}"
        texts.append((i, "head " + str(i * 7919) + "\n" + " ".join(words)))
    out = line_dedup.removed_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r.doc_id: r.removed.split(",")[-1] for r in out if r.doc_id} == {i: "1" for i in range(1, 60)}
    assert next(r.removed for r in out if r.doc_id == 0) == ""


def band_batches(lines, size=700):
    """One band of the lines, named by their places."""
    for at in range(0, len(lines), size):
        own = lines[at : at + size]
        yield pa.RecordBatch.from_arrays([pa.array([7] * len(own)), pa.array(range(at, at + len(own))), pa.array(own)], ["name", "line_hash", "line"])


def verified_edges(lines):
    return [e for b in line_dedup.verify_tasks(band_batches(lines)) for e in zip(*(c.to_pylist() for c in b.columns))]


@pytest.mark.parametrize("block", [(1, 10**6), (3, 10**6), (40, 10**6), (50, 300), (2_000, 10**6)])
def test_bands_of_many_blocks_are_linked_whole(block, monkeypatch):
    monkeypatch.setattr(line_dedup, "LINES_PER_BLOCK", block[0])
    monkeypatch.setattr(line_dedup, "BLOCK_CHARS", block[1])
    rnd = random.Random(8)
    lines = [f"lonely line number {i * 7919} of {rnd.random()}" for i in range(40)] + ["short", "shorter", "é" * 9, "a\rb"]
    for group in range(9):  # chains, where only neighbours are alike
        words = [f"{group}w{rnd.randint(0, 99999)}" for _ in range(12)]
        for step in range(12):
            words[step] = f"x{rnd.randint(0, 999)}"
            lines.append(" ".join(words))
    lines = list(dict.fromkeys(lines))
    rnd.shuffle(lines)
    grams = [line_dedup.shingles(x) for x in lines]
    pairs = [(i, j) for i in range(len(lines)) for j in range(i) if line_dedup.alike(grams[i], grams[j])]
    found = verified_edges(lines)
    expected = union_find(range(len(lines)), pairs)
    assert union_find(range(len(lines)), found) == expected
    assert len(found) == len(lines) - len(set(expected.values()))


def test_memory_of_a_band_has_a_bound():
    lines = [f"this sentence stands in a third of all documents, every time with the number {i:06d}" for i in range(20_000)]
    tracemalloc.start()
    found = verified_edges(lines)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == len(lines) - 1
    assert peak < 60e6


def test_very_big_bands_are_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "LINES_PER_TASK", 10)
    rows = [(1, i) for i in range(10)] + [(2, i) for i in range(11)] + [(3, i) for i in range(300)]
    groups = {}
    for r in line_dedup.dealt(spark.createDataFrame(rows, "name long, line_hash long")).collect():
        groups.setdefault(r.name, []).append(r.line_hash)
    assert sorted(groups[1]) == list(range(10)) and len(groups[1]) == 10
    met = {(a, b) for name, g in groups.items() if name != 1 for a in g for b in g}
    assert met == {(a, b) for a in range(300) for b in range(300)}
    assert max(map(len, groups.values())) < 80
    texts = [(i, f"this sentence stands in all documents, every time with number {i}") for i in range(120)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    few = sorted(map(tuple, line_dedup.removed_lines(docs).collect()))
    monkeypatch.setattr(line_dedup, "LINES_PER_TASK", 10**6)
    assert few == sorted(map(tuple, line_dedup.removed_lines(docs).collect()))


def plain_cuts(data):
    ends, at, table = [], 0, fingerprints.gear().tolist()
    hashes = []
    for i in range(len(data)):
        hashes.append(sum(table[data[i - j]] << j for j in range(min(32, i + 1))) % 2**32)
    while len(data) - at > fingerprints.LEAST:
        end = at + fingerprints.LEAST
        while end < len(data) and end < at + fingerprints.GREATEST:
            mask = fingerprints.STRICT if end < at + fingerprints.USUAL else fingerprints.LOOSE
            if hashes[end - 1] & int(mask) == 0:
                break
            end += 1
        ends.append(end)
        at = end
    return ends + ([len(data)] if at < len(data) else [])


def test_chunk_borders():
    rnd = random.Random(2)
    for n in (0, 1, 8, 9, 40, 700, 3000):
        data = bytes(rnd.choice(b"abcdefghij \n") for _ in range(n))
        assert fingerprints.cuts(data) == plain_cuts(data)
    assert fingerprints.cuts(b"a" * 1000)[-1] == 1000


@pytest.mark.parametrize("which", ["edge", "documents", "empty", "one", "no ids"])
def test_compared_with_next(which, request, spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "ROWS_PER_BUCKET", 7)
    docs = {
        "one": lambda: spark.createDataFrame([(4, "only one text here")], "doc_id long, text string"),
        "no ids": lambda: spark.createDataFrame([(None, "b"), (None, "a")], "doc_id long, text string"),
    }.get(which, lambda: request.getfixturevalue(which))()
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    found = fingerprints.compared_with_next(docs).collect()
    assert len(found) == len(rows)
    if which == "documents":
        rows.sort()
        expected = {}
        for (doc_id, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
            half = len(text) // 2
            new = text[: len(text) - half] + after[:half]
            own, other = fingerprints.chunks(text), fingerprints.chunks(new)
            expected[doc_id] = (
                doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), fingerprints.written(own),
                fingerprints.written(other), fingerprints.likeness(own, other), fingerprints.likeness(own, fingerprints.chunks(after)),
            )
        assert {r.doc_id: tuple(r) for r in found} == expected
    by_text = {}
    for doc_id, text in rows:
        by_text.setdefault(text, fingerprints.written(fingerprints.chunks(text)))
    assert sorted(r.fingerprint for r in found) == sorted(by_text[t] for _, t in rows)


def test_fingerprint_rows(edge):
    rows = zip(edge.select("doc_id", "text").collect(), fingerprints.fingerprint_rows(edge).collect())
    assert all(tuple(f) == (r.doc_id, fingerprints.written(fingerprints.chunks(r.text or ""))) for r, f in rows)


def test_likeness_survives_shifts():
    rnd = random.Random(9)
    text = " ".join(rnd.choice("alpha beta gamma delta rho".split()) + str(rnd.randint(0, 99)) for _ in range(400))
    own = fingerprints.chunks(text)
    assert fingerprints.likeness(own, fingerprints.chunks("something in front " + text)) > 0.9
    assert fingerprints.likeness(own, {}) == 0.0 and fingerprints.likeness({}, {}) == 1.0
