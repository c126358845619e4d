"""Spelling variants against all pairs, and the trees against plain distances."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from samples import DOCUMENTS

from terrasift.llm import spelling
from terrasift.llm.queries import QUERIES


def counts(rows, shortest=6, rare=5, chance=199):
    """The rule of the words, run by run."""
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{word}".encode())
            if doc_id is not None and h % chance == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1:]
            found[word] += 1
    return {w: n for w, n in found.items() if len(w) >= shortest and n >= rare}


def neighbours(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def plain(words, factor=5):
    near = {w: [v for v in words if neighbours(w, v)] for w in words}
    form = {}
    for w, around in near.items():
        best = min(around, key=lambda v: (-words[v], v), default=None)
        if best and words[best] >= factor * words[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()}


def as_set(df):
    rows = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query_matches_all_pairs(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    words = counts([(r.doc_id, r.text) for r in docs.collect()])
    assert as_set(QUERIES["op11_spelling_variants"](spark, folder)) == plain(words)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = as_set(spelling.variants(odd_docs, shortest=3, rare=1, chance=2))
    assert got == plain(counts(rows, 3, 1, 2))
    assert spelling.variants(no_docs).count() == 0


def test_chains_of_forms_are_followed(spark):
    # n grows fivefold at each step of the chain.
    ladder = ["kettel", "kettell", "kettelly", "kettellyo", "kettellyou"]
    text = " ".join(w for i, w in enumerate(ladder) for _ in range(5 ** (i + 1)))
    docs = spark.createDataFrame([(None, text, None, None, 0, "x", 1, "", "", "", "", "", "", "")], DOCUMENTS)
    got = {r.word: r for r in spelling.variants(docs).collect()}
    assert {r.root for r in got.values()} == {"kettellyou"} and got["kettel"].form == "kettell"
    assert got["kettellyou"].form is None and got["kettellyou"].root == "kettellyou"


def word_list(seed, many, letters="abcdé", longest=9):
    chance = random.Random(seed)
    return sorted({"".join(chance.choice(letters) for _ in range(chance.randint(6, longest))) for _ in range(many)})


@pytest.mark.parametrize("cell", [16, 4096])
def test_links_match_all_pairs_when_cells_split(spark, cell):
    # Permutations of one word cannot be split by letter counts.
    crowd = {"".join(random.Random(i).sample("abcdeé", 6)) for i in range(150)} | {"".join(random.Random(i).sample("abcdex", 6)) for i in range(150)}
    long = ["a" * 700, "a" * 701, "a" * 350 + "b" + "a" * 349, "b" + "a" * 699]
    words = sorted({*word_list(1, 500), *crowd, *long, "ÿ" * 6, "ÿ" * 7})
    df = spark.createDataFrame([(w, i + 1, len(w)) for i, w in enumerate(words)], "word string, n long, length int")
    got = Counter((r.word, r.near, r.near_n) for r in spelling.links(df, cell, 64).collect())
    want = Counter((a, b, j + 1) for a in words for j, b in enumerate(words) if neighbours(a, b))
    assert got == want


def pairs(asked, reach, stored):
    return [p for a, b in spelling.search(asked, reach, stored) for p in zip(a.tolist(), b.tolist())]


def test_search_in_one_cell():
    stored = [w for w in word_list(2, 900) if len(w) == 7]
    asked = [w for w in word_list(3, 900) if len(w) in (6, 7)]
    reach = np.array([2 if len(w) == 7 else 1 for w in asked])
    got = Counter((asked[i], stored[j]) for i, j in pairs(asked, reach, stored))
    assert got == Counter((a, b) for a in asked for b in stored if neighbours(a, b))
    same = ["abcdefg"[i:] + "abcdefg"[:i] for i in range(7)] * 10  # one vector, more than a leaf
    assert len(pairs(["xbcdefg", "abcefg"], np.array([2, 1]), same)) == 20


def test_every_point_has_one_leaf_and_every_near_one_is_reached():
    points = spelling.letter_counts(word_list(4, 800))
    tree = spelling.fitted(points)
    own = spelling.leaves(tree, points, np.zeros(len(points), int))
    assert sorted(i for _, index in own for i in index) == list(range(len(points))) and len(own) > 8
    home = {i: path for path, index in own for i in index}
    wide = {(path, i) for path, index in spelling.leaves(tree, points, np.full(len(points), 2)) for i in index}
    for i in range(0, len(points), 40):
        for j in np.flatnonzero(np.abs(points - points[i]).sum(axis=1) <= 2):
            assert (home[j], i) in wide


@pytest.mark.parametrize("a,b,near", [
    ("abc", "abd", True), ("abc", "abc", False), ("abc", "abcd", True), ("abc", "xabc", True), ("aab", "aaab", True),
    ("abc", "acb", False), ("abc", "axcd", False), ("abcdef", "abdcef", False),
])
def test_letter_order(a, b, near):
    assert spelling.one_edit(a, b) == near == neighbours(a, b)
    if len(a) <= len(b):
        assert (list(spelling.by_pattern([a], [b])) == [(0, 0)]) == near


def test_counts_follow_the_rule_run_by_run():
    chance = random.Random(8)
    rows = [(i, " ".join(chance.choice(["Ärger", "Gärten", "naïveté", "Étoile", "abcdefg", "ÀÀÀÀÀÀÀ", "x" * 9000]) for _ in range(40))) for i in range(30)]
    rows += [(None, "abcdefg " * 9), (-4, "GÄRTENx"), (7, None)]
    held = spelling.WordCounts(6, 5)
    held.add([None if i is None else str(i) for i, _ in rows], [t or "" for _, t in rows])
    got = Counter()
    for r in held.taken().to_pylist():
        got[r["word"]] += r["n"]
    assert got == counts(rows, 6, 1, 5)
    assert held.taken().num_rows == 0
