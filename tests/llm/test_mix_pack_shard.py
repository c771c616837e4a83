import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlode.llm import mixing, packing, queries, sharding

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes):
    """Share by weight, cap, share what is left again, until nobody is above the cap."""
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    out, left, free = {}, float(sum(sizes.values())), set(names)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] > 3 * sizes[s]}
        if not full:
            return out | share
        out |= {s: 3.0 * sizes[s] for s in full}
        left -= sum(out[s] for s in full)
        free -= full
    return out


def test_targets_with_full_sources(spark):
    sizes = {"b": 10, "a": 1000, "é": 3, "z": 0, None: 40, "c": 5}
    rows = [(s, n - n // 2) for s, n in sizes.items()] + [(s, n // 2) for s, n in sizes.items()]
    got = mixing.targets(spark.createDataFrame(rows, "source string, size long")).collect()
    want = plain_targets(sizes)
    assert {r.source: r.source_size for r in got} == sizes
    assert all(abs(r.target - want[r.source]) < 1e-6 for r in got)


def test_mix_comes_near_its_targets_and_repeats(spark):
    first = {r.doc_id: r for r in queries.op2_mixing(spark, SF).collect()}
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert set(first) == set(docs)
    sizes, taken, largest, target = defaultdict(int), defaultdict(int), defaultdict(int), {}
    for i, r in first.items():
        source = docs[i].source
        assert r.size == len(WORD.findall(docs[i].text)) and r.taken == r.copies * r.size and 0 <= r.copies <= 3
        sizes[source] += r.size
        taken[source] += r.taken
        largest[source] = max(largest[source], r.size)
        target[source] = r.target
    want = plain_targets(sizes)
    for source in sizes:
        assert abs(target[source] - want[source]) < 1e-6 * want[source]
        assert abs(taken[source] - target[source]) <= largest[source] / 2 + 1
    other = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet").repartition(7))
    assert {r.doc_id: r.taken for r in other.collect()} == {i: r.taken for i, r in first.items()}


def test_inclusion_follows_the_planned_copies(make_docs):
    rng = random.Random(3)
    docs = make_docs([("w " * (5 if i % 2 else 200) + str(rng.random()), "en", "ab"[i % 5 == 0]) for i in range(3000)])
    rows = mixing.mix(docs).collect()
    short = [r.copies for r in rows if r.size < 10 and r.source == "a"]
    long = [r.copies for r in rows if r.size > 10 and r.source == "a"]
    # Expected copies grow as the length class plus one: 3 against 8.
    assert abs((sum(short) / len(short)) / (sum(long) / len(long)) - 3 / 8) < 0.08


def test_mix_of_odd_rows(odd_docs, clashing, no_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.taken == 0 for r in rows if r.size == 0)
    assert len({r.copies for r in rows if r.doc_id == 4}) == 1
    again = mixing.mix(clashing)
    assert again.columns[: len(clashing.columns)] == clashing.columns
    assert sorted(r.taken_ for r in again.collect()) == sorted(r.taken for r in rows)
    repeated = mixing.mixed_rows(clashing)
    assert repeated.columns == clashing.columns and repeated.count() == sum(r.copies for r in rows)
    assert mixing.mix(no_docs).count() == 0


def plan_is_whole(counts, runs, capacity):
    used = defaultdict(set)
    fills = defaultdict(list)
    for length, rank, n, first, offset in runs:
        for i in range(n):
            assert rank + i not in used[length]
            used[length].add(rank + i)
            fills[first + i].append((offset, length))
    assert {k: len(v) for k, v in used.items()} == {i: c for i, c in enumerate(counts) if c}
    for parts in fills.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(fills)


@pytest.mark.parametrize("seed", range(6))
def test_plans_are_whole_and_tight(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(6.2, [0.3, 1.0, 1.6][seed % 3], [1, 50, 4000][seed % 3]).astype(int), 1, 2047)
    counts = np.bincount(lengths, minlength=2048).tolist()
    n = plan_is_whole(counts, packing.plan(counts), 2048)
    assert n <= 1.03 * max(lengths.sum() / 2048, (lengths > 1024).sum()) + 2
    assert packing.plan([0] * 2048) == []


def test_packing_matches_the_tokenizer(spark, odd_docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 4000").unionByName(
        odd_docs.where("doc_id is not null").withColumn("doc_id", F.col("doc_id") + 10**6).distinct()
    )
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = packing.pack(docs, path, with_ids=True).collect()
    pieces, sequences = defaultdict(dict), defaultdict(list)
    for r in rows:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        pieces[r.doc_id][r.piece] = r
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(texts)
    for i, parts in pieces.items():
        ids = [x for p in range(len(parts)) for x in parts[p].ids]
        assert ids == plain.encode(texts[i], add_special_tokens=False).ids + [0]
        assert [parts[p].start for p in range(len(parts))] == [2048 * p for p in range(len(parts))]
    for parts in sequences.values():
        ends = np.cumsum([0] + [n for _, n in sorted(parts)]).tolist()
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 2048


def test_packing_of_odd_rows(odd_docs, clashing, no_docs):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    for docs in (odd_docs, clashing):
        rows = packing.pack(docs, path).collect()
        assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter(r.doc_id for r in docs.collect())
        assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert packing.pack(no_docs, path).count() == 0


def test_fisher_yates_is_fair():
    seen = Counter(tuple(sharding.fisher_yates(3, 1, b).tolist()) for b in range(6000))
    assert len(seen) == 6 and max(seen.values()) < 1.2 * min(seen.values())


def test_shards_hold_every_row_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = queries.op9_sharding(spark, SF).collect()
    slots = defaultdict(list)
    for r in rows:
        data = texts.pop(r.doc_id).encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "rows", None)
        slots[r.shard].append(r.slot)
    assert not texts and set(slots) == set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    few = sharding.shard_rows(docs.repartition(5), bucket_bytes=200_000).collect()
    same = sharding.shard_rows(docs, bucket_bytes=200_000).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in few} == {(r.doc_id, r.shard, r.slot) for r in same}


def test_sharding_of_odd_rows(spark, odd_docs, clashing, no_docs, tmp_path):
    for docs in (odd_docs, clashing):
        made = sharding.shard_rows(docs, shards=3, bucket_bytes=1000)
        assert made.count() == docs.count() and made.columns[: len(docs.columns)] == docs.columns
    hot = spark.range(500).selectExpr("1L as doc_id", "'same text' as text")
    rows = sharding.shard_rows(hot, shards=4, bucket_bytes=500).collect()
    assert sorted((r.shard, r.slot) for r in rows) == [(s, i) for s in range(4) for i in range(125)]
    assert sharding.shard_rows(no_docs).count() == 0
    sharding.write_shards(odd_docs, str(tmp_path / "out"), shards=2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == odd_docs.count()
