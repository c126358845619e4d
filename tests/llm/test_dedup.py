import hashlib
import random
from collections import Counter

import pytest
from brute import components, fingerprint, normalised
from samples import rows
from pyspark.sql import functions as F

from terrasift.llm import exact_dedup, simhash_dedup


def test_exact_groups_match_brute_force(odd_docs):
    got = exact_dedup.groups(odd_docs, capacity=3).collect()
    texts = {}
    for row in rows():
        texts.setdefault(normalised(row[1]), []).append(row[0])
    want = Counter()
    for text, ids in texts.items():
        keep = min((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    # One row of each group stays, also where a row is repeated.
    assert sum(r.kept for r in got) == len(texts)


def test_exact_keeps_rows_whole(odd_docs, no_docs):
    kept = exact_dedup.deduplicate(odd_docs, capacity=3)
    assert kept.columns == odd_docs.columns
    assert Counter(normalised(r.text) for r in kept.collect()) == Counter({normalised(r[1]): 1 for r in rows()})
    assert exact_dedup.deduplicate(no_docs).count() == 0
    assert exact_dedup.groups(no_docs).count() == 0


def test_directory_doubles_until_buckets_fit(spark):
    keys = spark.range(2000).select(F.xxhash64("id").alias("key"))
    places, depth = exact_dedup.directory(keys, capacity=50)
    fill = keys.withColumn("slot", exact_dedup.leading_bits(F.col("key"), depth)).join(places, "slot")
    counts = {r.bucket: r["count"] for r in fill.groupBy("bucket").count().collect()}
    assert max(counts.values()) <= 50 and sum(counts.values()) == 2000
    listed = places.collect()
    assert len(listed) == 1 << depth
    # A bucket of local depth d is named by 2^(depth - d) slots.
    shares = Counter(r.bucket for r in listed)
    assert all(shares[r.bucket] == 1 << (depth - r.local_depth) for r in listed)


def test_directory_lets_sparse_neighbours_share_a_bucket(spark):
    crowded = spark.range(64).select((F.shiftleft(F.col("id"), 50)).alias("key"))
    places, depth = exact_dedup.directory(crowded, capacity=16)
    assert depth >= 5
    assert len({r.bucket for r in places.collect()}) < 1 << depth


@pytest.mark.parametrize("text", [None, "", "one", "One two", "a b c d e f g", "É É é " * 40, "x " * 70_000])
def test_fingerprint_matches_brute_force(text):
    assert simhash_dedup.fingerprint(text or "") == fingerprint(text)


def test_every_close_pair_shares_a_table():
    chance = random.Random(3)
    for free in (simhash_dedup.ALL_BITS, 0xFFFF0000FF00, 0b1011011):
        masks = simhash_dedup.covering_masks(free)
        places = [i for i in range(64) if free >> i & 1]
        for _ in range(300):
            flipped = sum(1 << p for p in chance.sample(places, 2))
            assert any(not mask & flipped for mask in masks)


def test_links_match_all_pairs_in_dense_clusters(spark):
    chance = random.Random(5)
    centre, loose = chance.getrandbits(64), chance.sample(range(64), 11)
    # Far more than DIRECT fingerprints agree on 53 positions, so buckets are split twice over.
    prints = {centre ^ sum(1 << b for b in loose if chance.random() < 0.5) for _ in range(500)}
    prints |= {chance.getrandbits(64) for _ in range(100)} | {0, 1, simhash_dedup.ALL_BITS}
    df = spark.createDataFrame([(simhash_dedup.signed(p),) for p in prints], "fp long")
    got = {(r.a, r.b) for r in simhash_dedup.links(df).collect()}
    listed = sorted(simhash_dedup.signed(p) for p in prints)
    mask = simhash_dedup.ALL_BITS
    want = {(a, b) for i, a in enumerate(listed) for b in listed[i + 1:] if ((a ^ b) & mask).bit_count() <= 2}
    assert got == want


def test_simhash_components_match_brute_force(odd_docs, no_docs):
    got = simhash_dedup.components(odd_docs).collect()
    listed = sorted(rows(), key=lambda r: (r[0] is None, r[0] or 0))
    prints = [fingerprint(r[1]) for r in listed]
    want = Counter((r[0], f"{p:016x}", listed[c][0]) for r, p, c in zip(listed, prints, components(prints)))
    assert Counter((r.doc_id, f"{r.fp & simhash_dedup.ALL_BITS:016x}", r.component_id) for r in got) == want
    kept = simhash_dedup.deduplicate(odd_docs)
    assert kept.columns == odd_docs.columns
    assert kept.count() == len({c for c in components(prints)})
    assert simhash_dedup.components(no_docs).count() == 0
    assert simhash_dedup.deduplicate(no_docs).count() == 0
