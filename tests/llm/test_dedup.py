import random
import re

import numpy as np
from pyspark.sql import functions as F

from reviewlode.llm import common, embedding_dedup, jaccard_join
from reviewlode.llm.shingles import shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def plain_set(text, k=5):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < k:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def roots(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(texts, percent=80):
    sets = {i: plain_set(t) for i, t in enumerate(texts)}
    linked = [
        (i, j)
        for i in sets
        for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    ]
    found = roots(sets, linked)
    return {i: (len(sets[i]), found[i]) for i in sets}


def corpus(seed):
    """Groups of edits of edits, a shared passage, and texts of few words."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = rng.choices(vocabulary, k=25)
    texts = []
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.choice([3, 6, 12, 40, 120]))
        if rng.random() < 0.5:
            base[len(base) // 2 : len(base) // 2] = passage
        chain = base
        for _ in range(rng.choice([1, 2, 12])):
            texts.append(" ".join(chain))
            chain = list(chain if rng.random() < 0.6 else base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                chain[rng.randrange(len(chain))] = rng.choice(vocabulary)
    texts += ["", None, "  \n", "a b", "A  B", "b a"]
    rng.shuffle(texts)
    return texts


def test_components_match_all_pairs(make_docs):
    texts = corpus(1)
    got = jaccard_join.jaccard_components(make_docs(texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(texts)


def test_rounds_windows_and_cut_lists_change_nothing(make_docs):
    """A large group of near copies around two centres."""
    rng = random.Random(5)
    base = [f"v{i}" for i in range(60)]
    texts = []
    for i in range(70):
        words = list(base)
        for _ in range(i % 4):
            words[rng.randrange(60)] = f"x{rng.randrange(9)}"
        texts.append(" ".join(words))
    got = jaccard_join.jaccard_components(make_docs(texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(texts)


def test_exact_threshold_links(make_docs):
    words = [f"k{i}" for i in range(13)]  # nine shingles; one word at the end changes one of them
    texts = [" ".join(words), " ".join(words[:-1] + ["z"]), " ".join(words[:9]), " ".join([*words[:8], "z"])]
    got = jaccard_join.jaccard_components(make_docs(texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(texts)


def test_odd_rows_and_clashing_columns(odd_docs, clashing, no_docs):
    for docs in (odd_docs, clashing):
        rows = jaccard_join.jaccard_components(docs).collect()
        assert len(rows) == docs.count()
        by_id = {r.doc_id: r for r in rows}
        assert by_id[0].n_shingles == by_id[1].n_shingles == by_id[2].n_shingles == 0
        assert by_id[0].component_id == 0 and by_id[1].component_id == 1
        assert by_id[5].component_id == by_id[4].component_id == 4
        kept = jaccard_join.keep_one(docs)
        assert kept.columns == docs.columns
        assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [0, 1, 2, 3, 4, 6, 7]
        assert kept.where("doc_id is null").count() == 1
    assert jaccard_join.jaccard_components(no_docs).count() == 0
    assert jaccard_join.keep_one(no_docs).count() == 0


def test_repeated_and_missing_ids_keep_their_own_links(spark):
    """Texts that share an id, or have none, link by their own sets, and one row of each component stays."""
    words = [f"q{i}" for i in range(40)]
    one, near, other = " ".join(words), " ".join([*words[:-1], "z"]), " ".join(reversed(words))
    rows = [(5, one), (5, other), (None, near), (None, "lone " * 9), (None, "lone " * 9), (2, other), (7, ""), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.jaccard_components(docs)
    counted = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got.collect())
    want = [("5", 36, "5"), ("5", 36, "2"), ("None", 36, "5"), ("2", 36, "2")]
    assert counted == sorted(want + [("None", 1, "None")] * 2 + [("7", 0, "7")] * 2)
    kept = jaccard_join.keep_one(docs).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("5", one), ("2", other), ("None", "lone " * 9), ("7", "")])


def test_one_vector_stays_beside_clashing_names(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.001], 0), (3, [0.0, 1.0], 0), (4, None, 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    clash = vectors.withColumns({n: F.lit(7) for n in ("kept_vector", "kept", "id", "c", "v", "t", "n_links")})
    kept = embedding_dedup.keep_one(clash)
    assert kept.columns == clash.columns and sorted(r.vec_id for r in kept.collect()) == [1, 3, 4]


def test_shingles_do_not_depend_on_the_batch():
    texts = corpus(3)
    together = [s.tolist() for s in shingle_sets(texts)]
    assert together == [next(iter(shingle_sets([t]))).tolist() for t in texts]
    assert [len(s) for s in together] == [len(plain_set(t)) for t in texts]


def test_components_of_a_path_a_star_and_a_ring(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 60)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    random.Random(1).shuffle(edges)
    got = common.components(spark.createDataFrame(edges, "u long, v long")).collect()
    want = roots({n for e in edges for n in e}, edges)
    assert {r.node: r.root for r in got} == {n: r for n, r in want.items() if n != r}


def test_vectors_match_all_pairs(spark):
    rng = np.random.default_rng(1)
    values, labels = [], []
    for label in (0, 1):
        base = rng.standard_normal((60, 24))
        near = base[rng.integers(0, 6, 80)] + 0.11 * rng.standard_normal((80, 24))
        group = base[9] + 0.1 * rng.standard_normal((700, 24))
        copies = np.repeat(base[:1], 9, axis=0)
        part = np.concatenate([base, near, group, copies, 3.0 * base[:3]])
        values.append(part)
        labels += [label] * len(part)
    values, labels = np.concatenate(values), np.array(labels)
    rows = [(i, v.tolist(), int(x)) for i, (v, x) in enumerate(zip(values, labels, strict=True))]
    n = len(rows)
    odd = [None, [0.0] * 24, [float("nan")] * 24, [float("inf")] * 24, [None] * 24, []]
    rows += [(n + i, v, 0) for i, v in enumerate(odd)] + [(n + 6, [1.0] * 24, None), (n + 7, [1.0] * 24, None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("c", F.lit(1))
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(table).collect()}
    unit = values / np.linalg.norm(values, axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.98) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(linked, False)
    want = roots(range(n), zip(*np.nonzero(linked), strict=True))
    assert [got[i].n_links for i in range(n)] == linked.sum(axis=1).tolist()
    assert [got[i].component_id for i in range(n)] == [want[i] for i in range(n)]
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(n, n + 8))
    assert embedding_dedup.keep_one(table).count() == len(set(want.values())) + 8
    assert embedding_dedup.near_vectors(table.limit(0)).count() == 0


def test_tables_keep_the_recall_promised():
    for n in (1, 100, 10**6, 10**10):
        bits, tables = embedding_dedup.shape(n, 0.98)
        meet = (1 - np.arccos(0.98) / np.pi) ** bits
        assert (1 - meet) ** tables <= 1.01e-5




def test_empty_text_comes_first(monkeypatch):
    from reviewlode.llm import shingles

    monkeypatch.setattr(shingles, "_powers", {})
    assert [s.tolist() for s in shingle_sets([None])] == [[]] and len(next(iter(shingle_sets(["a b"])))) == 1
