import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import n_words, targets
from samples import rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terrasift.llm import mixing, packing, sharding

FOLDER = "/root/testdata/sf0.01"


def test_amounts_on_odd_rows(odd_docs, no_docs):
    got = mixing.amounts(odd_docs).collect()
    assert len(got) == len(rows())
    sizes = defaultdict(int)
    for r in rows():
        sizes[r[3]] += n_words(r[1])
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, targets([sizes[s] for s in names], [1 + i % 3 for i in range(len(names))])))
    ids = {r[0]: r[3] for r in rows() if r[0] not in (9, 11)}
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"] and r["copies"] == len(r.shards)
        if r.doc_id in ids:
            assert r.source_size == sizes[ids[r.doc_id]] and r.target == pytest.approx(want[ids[r.doc_id]])
    assert mixing.amounts(no_docs).count() == 0
    assert mixing.mix(no_docs).count() == 0


def test_mix_comes_near_targets_and_agrees_with_amounts(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    amounts = mixing.amounts(docs, shards=8).join(docs.select("doc_id", "source"), "doc_id").collect()
    taken, target, largest = defaultdict(int), {}, defaultdict(int)
    for r in amounts:
        taken[r.source] += r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r["size"])
    for source, words in target.items():
        assert abs(taken[source] - words) <= max(0.05 * words, 0)
    mixed = mixing.mix(docs, shards=8)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.select("doc_id").collect()) == Counter({r.doc_id: r["copies"] for r in amounts if r["copies"]})
    again = mixing.amounts(docs.repartition(5), shards=8).select("doc_id", "taken", "shards").collect()
    assert {r.doc_id: (r.taken, r.shards) for r in again} == {r.doc_id: (r.taken, r.shards) for r in amounts}


def test_splitting_tree_deals_every_draw(spark):
    full = spark.createDataFrame([(0, 1000), (1, 0), (2, 37), (3, 4096)], "place int, draws int")
    runs = {r.place: r.runs for r in mixing.runs(full, 16).collect()}
    assert {p: r[-1] for p, r in runs.items()} == {0: 1000, 1: 0, 2: 37, 3: 4096}
    each = np.diff(np.array([[0, *runs[p]] for p in range(4)]), axis=1)
    assert (each >= 0).all()
    assert set(each.sum(0)) <= {320, 321, 322} and each.sum() == 5133
    # A source's part of a shard spreads as a draw without replacement does.
    assert 30 <= each[0].min() and each[0].max() <= 95


def test_hypergeometric_has_its_mean_and_variance(spark):
    uniform = (F.col("id") + 0.5) / 4000
    x = [r.x for r in spark.range(4000).select(
        mixing.hypergeometric(uniform, F.lit(30), F.lit(100), F.lit(40)).alias("x")
    ).collect()]
    assert np.mean(x) == pytest.approx(12, abs=0.02)
    assert np.var(x) == pytest.approx(40 * 0.3 * 0.7 * 60 / 99, rel=0.02)
    edge = spark.range(1).select(
        mixing.hypergeometric(F.lit(0.3), F.lit(0), F.lit(9), F.lit(4)).alias("none"),
        mixing.hypergeometric(F.lit(0.3), F.lit(9), F.lit(9), F.lit(4)).alias("all"),
        mixing.hypergeometric(F.lit(0.3), F.lit(0), F.lit(0), F.lit(0)).alias("empty"),
    ).first()
    assert tuple(edge) == (0, 4, 0)


def test_pieces_cover_each_id_once(odd_docs, no_docs):
    cut = packing.pieces(odd_docs, length=256)
    got = cut.collect()
    tokenizer = Tokenizer.from_file(packing.TOKENIZER)
    want = Counter(
        np.array(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1], "<u4").tobytes() for r in rows()
    )
    docs, current = [], {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert len(r.ids) == 4 * r.length
        if r.start == 0:
            current = {"ids": b"", "n": r.doc_tokens}
            docs.append(current)
        assert r.start * 4 == len(current["ids"])
        current["ids"] += r.ids
    assert Counter(d["ids"] for d in docs) == want and all(len(d["ids"]) == 4 * d["n"] for d in docs)
    whole = {r.sequence_id: r.ids for r in packing.sequences(cut).collect()}
    assert all(len(whole[i]) == 1024 for i in range(len(whole) - 1))
    assert packing.pieces(no_docs).count() == 0


@pytest.mark.parametrize("text", [
    "", "It's  a <|endoftext|> test, isn't it?", "é́ ́x ﬁ Å y z\x1cq", "\n\n  Ünïcode\t12345 ... ''s", "a" * 3000, "x " + "é" * 300 + " y",
    "I'll we're they've 'tis ''tis don't'd \"'s 12'3s ²½", "ß STRASSE ÿ \xa0 \xad",
])
def test_word_ids_are_the_tokenizers(text):
    words = packing.WordIds(packing.TOKENIZER, remembered=3, at_once=2)
    want = np.array(Tokenizer.from_file(packing.TOKENIZER).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert words.encode([text, text]) == [want] * 2
    single = words.whole("a")
    assert packing.WordIds(packing.TOKENIZER).encode(["", text, "a", text]) == [b"", want, single, want]


def test_random_latin_texts_get_the_tokenizers_ids():
    chance, whole = random.Random(2), Tokenizer.from_file(packing.TOKENIZER)
    letters = "abestrvlmd'''\"  \n\t09½²ÀéßµA.,-×÷"
    texts = ["".join(chance.choice(letters) for _ in range(chance.randint(0, 60))) for _ in range(800)]
    texts += ["we'll", "'re", "x'dd 're's''s 't", "\"'s", "1'm 2", "it'S I'LL", "'v'e", "'l", "'", "''", "é'ré'd"]
    got = packing.WordIds(packing.TOKENIZER, at_once=500).encode(texts)
    for text, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_hilbert_index_steps_by_one_cell():
    for bits, dimensions in ((3, 2), (2, 3)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * dimensions, indexing="ij"), -1).reshape(-1, dimensions)
        order = np.argsort(sharding.hilbert_index(cells, bits))
        assert sorted(sharding.hilbert_index(cells, bits)) == list(range(side**dimensions))
        assert (np.abs(np.diff(cells[order], axis=0)).sum(1) == 1).all()


def test_shards_differ_by_one_row(odd_docs, no_docs, tmp_path, spark):
    got = sharding.place(odd_docs, 4).collect()
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and sum(counts.values()) == len(rows())
    for shard, n in counts.items():
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(n))
    want = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    assert sharding.place(no_docs, 4).count() == 0
    few = sharding.place(odd_docs.limit(2), 24).collect()
    assert sorted(r.shard for r in few) == [0, 1]
    sharding.write(odd_docs, str(tmp_path / "shards"), 4)
    written = spark.read.parquet(str(tmp_path / "shards"))
    assert written.count() == len(rows())
    assert Counter(r.doc_id for r in written.select("row.doc_id").collect()) == Counter(r[0] for r in rows())
