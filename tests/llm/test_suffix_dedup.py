"""Suffix dedup against a dictionary of all strings, and its sorting against plain sorting."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from samples import DOCUMENTS

from terrasift.llm import suffix_dedup
from terrasift.llm.queries import QUERIES

SMALL = dict(length=24, grams=(8, 16, 24))


def plain(texts, length=200):
    """(bytes, removed, spans, digest of the rest) per text, all starts of all texts in one dictionary."""
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[p:p + length] for b in bodies for p in range(len(b) - length + 1))
    out = []
    for body in bodies:
        gone = np.zeros(len(body) + 1, np.int8)
        for p in range(len(body) - length + 1):
            if seen[body[p:p + length]] > 1:
                gone[p:p + length] = 1
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone])) == 1))
        rest = bytes(b for b, g in zip(body, gone) if not g)
        out.append((len(body), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()))
    return out


def result(df):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.parts), hashlib.sha256(r.kept).hexdigest()) for r in df.collect())


def documents(spark, texts):
    rows = [(i, t, "en", "a", 0, "x", 1, "", "", "", "", "", "", "") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCUMENTS).repartition(3)


def some_texts(seed=1):
    chance = random.Random(seed)

    def words(n):
        return " ".join("".join(chance.choice("abcdeé") for _ in range(chance.randint(2, 7))) for _ in range(n))

    shared = [words(8) for _ in range(3)]
    base = words(60)
    near = [base[:90] + "#" + base[91:], base[:30] + base[33:], base + " end", "x" + base]
    mixed = [words(10) + " " + chance.choice(shared) + " " + words(10) for _ in range(40)]
    return [base, *near, *mixed, "ab" * 60, "z" * 100, "z" * 23, "z" * 24, shared[0], shared[0], None, "", "short", "short", "é" * 30, words(30)]


@pytest.mark.parametrize("how", [{}, {"crowd": 3}, {"block": 40}, {"crowd": 1, "block": 30}])
def test_removed_bytes_match_all_starts(spark, how):
    texts = some_texts()
    want = Counter((i, *w) for i, w in enumerate(plain(texts, 24)))
    assert result(suffix_dedup.deduplicate(documents(spark, texts), **SMALL, **how)) == want


def test_odd_rows(spark, odd_docs, no_docs):
    rows = odd_docs.collect()
    # The long text is periodic and stands in two rows: it goes whole.
    want = Counter((r.doc_id, *w) for r, w in zip(rows, plain([r.text if len(r.text or "") < 10_000 else None for r in rows])))
    long = next(r.text for r in rows if len(r.text or "") > 10_000)
    size = len(long.encode())
    for i in (7, 8):
        del want[next(k for k in want if k[0] == i)]
        want[(i, size, size, 1, hashlib.sha256(b"").hexdigest())] = 1
    assert result(suffix_dedup.deduplicate(odd_docs)) == want
    assert suffix_dedup.deduplicate(no_docs).count() == 0


def test_query_matches_all_starts(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    want = Counter((d.doc_id, *w) for d, w in zip(docs, plain([d.text for d in docs])))
    got = QUERIES["op12_suffix_dedup"](spark, folder).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def test_a_passage_in_every_document_goes(spark):
    chance = random.Random(9)
    passage = "".join(chance.choice("abcdefgh ") for _ in range(260))
    texts = ["".join(chance.choice("abcdefgh ") for _ in range(150)) + passage + str(i) * 3 for i in range(60)]
    want = Counter((i, *w) for i, w in enumerate(plain(texts)))
    got = result(suffix_dedup.deduplicate(documents(spark, texts), crowd=8))
    assert got == want and all(k[2] >= 260 for k in got)


@pytest.mark.parametrize("seed", range(4))
def test_deep_and_shallow_order(seed):
    chance = random.Random(seed)
    data = bytes(chance.choice(b"ab") for _ in range(400)) + b"ab" * 80 + b"a" * 90
    length, known = 40, 16
    starts = list(range(len(data) - length + 1))
    groups = suffix_dedup.shallow_groups(np.frombuffer(data, np.uint8), np.array(starts), known)
    heads = Counter(data[s:s + known] for s in starts)
    assert [(data[g[0]:g[0] + known], len(g)) for g in groups] == sorted((h, n) for h, n in heads.items() if n > 1)
    for group in groups:
        order = suffix_dedup.deep_order(data, group.tolist(), known, length)
        texts = [data[m[0]:m[0] + length] for m in order]
        assert texts == sorted(set(texts)) and {s for m in order for s in m} == set(group.tolist())
        assert all(data[s:s + length] == t for m, t in zip(order, texts) for s in m)


def test_equal_strings_share_their_anchor():
    chance = random.Random(3)
    anchors = suffix_dedup.Anchors(8, 24)
    body = bytes(chance.choice(b"abc") for _ in range(300))
    other = b"q" * 11 + body[40:200] + b"r" * 30
    first, second = (np.frombuffer(b, np.uint8) for b in (body, other))
    a, b = anchors.of(first)[0], anchors.of(second)[0]
    assert all(a[40 + i] - 40 == b[11 + i] - 11 for i in range(160 - 24 + 1))
    assert (np.diff(a) >= 0).all() and all(0 <= a[p] - p <= 16 for p in range(len(a)))
