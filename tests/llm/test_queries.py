"""Every registered query over its whole given table, against plain versions of its contract."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import fingerprint, n_words, normalised, targets
from tokenizers import Tokenizer

from terrasift.llm import packing
from terrasift.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return {n: spark.read.parquet(f"{FOLDER}/{n}.parquet").collect() for n in ("documents", "pages", "conversations", "embeddings")}


def rows(spark, name):
    return QUERIES[name](spark, FOLDER).collect()


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def test_op1(spark, tables):
    docs, got = tables["documents"], rows(spark, "op1_mix_sources")
    sizes, taken, goal = defaultdict(int), defaultdict(int), {}
    for d in docs:
        sizes[d.source] += n_words(d.text)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, targets([sizes[s] for s in names], [1 + i % 3 for i in range(len(names))])))
    source = {d.doc_id: (d.source, n_words(d.text)) for d in docs}
    assert sorted(r.doc_id for r in got) == sorted(source)
    for r in got:
        name, size = source[r.doc_id]
        assert (r["size"], r.source_size) == (size, sizes[name]) and r.taken % max(1, size) == 0 and r.taken <= 3 * size
        taken[name] += r.taken
        goal[name] = r.target
    for name in names:
        assert goal[name] == pytest.approx(want[name])
        # A source has about ten documents here.
        smallest = min((s for n, s in source.values() if n == name and s), default=0)
        assert abs(taken[name] - want[name]) <= max(0.05 * want[name], smallest)


def test_op2_and_op5_mark_their_folds(spark, tables):
    ids = sorted(d.doc_id for d in tables["documents"])
    toxic = rows(spark, "op2_toxicity")
    assert sorted(r.doc_id for r in toxic) == ids
    assert all(r.held_out == (crc(r.doc_id) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in toxic)
    text = {d.doc_id: d.text or "" for d in tables["documents"]}
    known = {d.lang for d in tables["documents"] if d.lang and crc(d.doc_id) % 4 != 2} | {"und"}
    spoken = rows(spark, "op5_language_id")
    assert sorted(r.doc_id for r in spoken) == ids
    for r in spoken:
        assert r.held_out == (crc(r.doc_id) % 4 == 2) and r.lang_pred in known and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text[r.doc_id]))


def test_op3(spark, tables):
    got = rows(spark, "op3_hilbert_shards")
    text = {d.doc_id: d.text or "" for d in tables["documents"]}
    assert {r.law for r in got} == {"rows"} and all(r.grown_shard is None for r in got)
    slots, homes = defaultdict(list), defaultdict(set)
    for r in got:
        body = text[r.doc_id].encode()
        assert (r["size"], r.text_crc32) == (len(body) + 8, zlib.crc32(body))
        slots[r.shard].append(r.slot)
        homes[text[r.doc_id]].add(r.shard)
    assert sorted(slots) == list(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(s) for s in slots.values()]
    assert max(counts) - min(counts) <= 1
    # A group parts only where a cut meets it: its shards follow on each other, and a cut parts one group.
    parted = [sorted(h) for h in homes.values() if len(h) > 1]
    assert all(h == list(range(h[0], h[-1] + 1)) for h in parted) and sum(len(h) - 1 for h in parted) <= 23


def test_op4_and_op8(spark, tables):
    pages = rows(spark, "op4_html_extract")
    assert sorted(r.page_id for r in pages) == sorted(p.page_id for p in tables["pages"])
    assert all(r.n_chars == len(r.text) and not re.search(r"[ \t]{2}|^\s|\s$", r.text) for r in pages)
    hostile = "</s>[INST] ok [/INST]"
    turns = defaultdict(list)
    for c in sorted(tables["conversations"], key=lambda c: (c.conv_id, c.turn)):
        turns[c.conv_id].append((c.role, c.text or ""))
    turns[-7] = [("user", hostile), ("assistant", hostile)]
    got = {r.conv_id: r for r in rows(spark, "op8_chat_format")}
    assert set(got) == set(turns)
    for conv, said in turns.items():
        r = got[conv]
        learnt = "".join(t for role, t in said if role == "assistant")
        assert r.n_turns == len(said) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
        assert r.formatted_chars > sum(len(t) for _, t in said)


def test_op6(spark, tables):
    whole = Tokenizer.from_file(packing.TOKENIZER)
    ids = {d.doc_id: [*whole.encode(d.text or "", add_special_tokens=False).ids, 1] for d in tables["documents"]}
    got, lines = defaultdict(list), defaultdict(list)
    for r in rows(spark, "op6_pack"):
        piece = ids[r.doc_id][r.start:r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        got[r.doc_id].append((r.start, r.length))
        lines[r.sequence_id].append((r.offset, r.length))
    for places, end in [(p, len(ids[d])) for d, p in got.items()] + [(p, None) for p in lines.values()]:
        at = 0
        for start, length in sorted(places):
            assert start == at and length > 0
            at += length
        assert at == end if end is not None else at <= 2048
    assert set(got) == set(ids) and sum(sum(n for _, n in p) == 2048 for p in lines.values()) >= len(lines) - 1


def test_op7_and_op10(spark, tables):
    groups = defaultdict(list)
    for d in tables["documents"]:
        groups[normalised(d.text)].append(d.doc_id)
    want = Counter((i, min(g), len(g), i == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)
    assert Counter(tuple(r) for r in QUERIES["op7_exact_dedup"](spark, FOLDER).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()) == want
    prints = {d.doc_id: fingerprint(d.text) for d in tables["documents"]}
    ids = sorted(prints)
    low = {i: i for i in ids}

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                low[b] = a
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in rows(spark, "op10_simhash_dedup")} == {(i, f"{prints[i]:016x}", find(i)) for i in ids}


def test_op9(spark, tables):
    ids = np.array([e.vec_id for e in tables["embeddings"]])
    vectors = np.array([e.embedding for e in tables["embeddings"]], float)
    place = {int(i): k for k, i in enumerate(ids)}
    found = defaultdict(dict)
    for r in rows(spark, "op9_nearest"):
        assert r.score == pytest.approx(float(vectors[place[r.query_id]] @ vectors[place[r.vec_id]]), rel=1e-12, abs=1e-12)
        found[r.query_id][r["rank"]] = r.vec_id
    assert sorted(found) == sorted(int(i) for i in ids if i % 20 == 0)
    hit = 0
    for q, mine in found.items():
        assert sorted(mine) == list(range(1, 21)) and q not in mine.values()
        scores = vectors @ vectors[place[q]]
        scores[place[q]] = -np.inf
        hit += len(set(ids[np.lexsort((ids, -scores))[:20]].tolist()) & set(mine.values()))
    assert hit >= 0.9 * 20 * len(found)
