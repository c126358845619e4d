"""The stages of the corpus, each held against a plain version on its own input."""

import zlib
from collections import Counter, defaultdict

import numpy as np
from brute import components, fingerprint, n_words, normalised, targets
from samples import DOCUMENTS
from tokenizers import Tokenizer

import corpus_pipeline
from terrasift.llm import packing

FOLDER = "/root/testdata/sf0.001"


def test_each_stage_on_its_input(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, kept = docs.columns, {"documents": docs.collect()}
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, FOLDER)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
        if name != "pack":
            assert docs.columns == columns
            assert {r.doc_id for r in kept[name]} <= {r.doc_id for r in kept["documents"]}

    # Clean documents stay.
    before, after = kept["documents"], kept["language_id"]
    assert len(after) >= 0.98 * len(before)

    first = {}
    for r in sorted(kept["language_id"], key=lambda r: r.doc_id):
        first.setdefault(normalised(r.text), r.doc_id)
    assert sorted(r.doc_id for r in kept["exact_dedup"]) == sorted(first.values())

    listed = sorted(kept["exact_dedup"], key=lambda r: r.doc_id)
    roots = components([fingerprint(r.text) for r in listed])
    assert sorted(r.doc_id for r in kept["simhash_dedup"]) == sorted({listed[i].doc_id for i in roots})

    sizes = defaultdict(int)
    for r in kept["simhash_dedup"]:
        sizes[r.source] += n_words(r.text)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, targets([sizes[n] for n in names], [1 + i % 3 for i in range(len(names))])))
    taken, largest = defaultdict(int), defaultdict(int)
    for r in kept["mix_sources"]:
        taken[r.source] += n_words(r.text)
        largest[r.source] = max(largest[r.source], n_words(r.text))
    assert all(abs(taken[n] - want[n]) <= max(0.05 * want[n], largest[n] / 2) for n in names)
    assert max(Counter(r.doc_id for r in kept["mix_sources"]).values()) <= 3

    tokenizer = Tokenizer.from_file(packing.TOKENIZER)
    pieces = sorted(kept["pack"], key=lambda r: (r.sequence_id, r.offset))
    assert sum(r.length for r in pieces) == sum(
        len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in kept["mix_sources"]
    )
    text = {r.doc_id: r.text for r in kept["mix_sources"]}
    for r in pieces[:40]:
        ids = np.array([*tokenizer.encode(text[r.doc_id], add_special_tokens=False).ids, 1], "<u4")[r.start:r.start + r.length]
        assert zlib.crc32(ids.tobytes()) == r.ids_crc32


def test_stages_on_odd_and_empty_tables(spark, odd_docs, tmp_path):
    for kind, docs in (("odd", odd_docs), ("empty", spark.createDataFrame([], DOCUMENTS))):
        rows = docs.count()
        for name, step in corpus_pipeline.STAGES:
            step(spark, docs, FOLDER).write.parquet(str(tmp_path / kind / name))
            docs = spark.read.parquet(str(tmp_path / kind / name))
        assert (docs.count() > 0) == (rows > 0)
