"""Vector codes, fill-in-the-middle and vector packing against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from reviewlode.llm import byte_tokens, fill_middle, piece_table, queries, vector_codes, vector_packing

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


def plain_codes(rows, parts, entries, rounds, scale):
    """Codes, errors and codebooks by comparing every part with every entry in Python's whole numbers."""
    rows = sorted(rows, key=lambda r: r[0])
    width = len(rows[0][1]) // parts
    cut = [[[int(np.floor(x * scale)) for x in v[p * width : (p + 1) * width]] for p in range(parts)] for _, v in rows]
    books = [[list(q[p]) for q in cut[:entries]] for p in range(parts)]

    def assign():
        out = []
        for q in cut:
            far = [[sum((a - b) ** 2 for a, b in zip(q[p], c, strict=True)) for c in books[p]] for p in range(parts)]
            out.append([(min(f), f.index(min(f))) for f in far])
        return out

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [q[p] for q, f in zip(cut, found, strict=True) if f[p][1] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return {r[0]: ([e for _, e in f], sum(d for d, _ in f)) for r, f in zip(rows, assign(), strict=True)}, books


@pytest.mark.parametrize("seed", range(3))
def test_codes_match_plain_comparison(spark, seed):
    rng = np.random.default_rng(seed)
    # Clusters, so that cores and rings are used, and values of few steps, so that there are ties.
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + rng.normal(size=8) * (0.05 if i % 3 else 1)).round(1 + seed).tolist(), i % 4) for i in range(400)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    codes, books = vector_codes.compress(frame, parts=4, entries=20, rounds=3, scale=16)
    want, want_books = plain_codes([r[:2] for r in rows], 4, 20, 3, 16)
    assert books.tolist() == want_books
    assert {r.vec_id: (list(r.codes), r.far) for r in codes.collect()} == want


def test_balls_skip_work_and_lose_nothing():
    rng = np.random.default_rng(5)
    centres = rng.integers(-1000, 1000, (40, 3))
    values = centres[rng.integers(0, 40, 5000)] + rng.integers(-60, 60, (5000, 3))
    codes, _ = vector_codes.nearest(values, centres)
    moved = centres + rng.integers(-20, 20, (40, 3))
    far = np.zeros(40)
    np.maximum.at(far, codes, ((values - moved[codes]) ** 2).sum(axis=1))
    balls = vector_codes.Balls(moved, np.ceil(np.sqrt(far)).astype(np.int64) + 1)
    got, want = balls.nearest(values, codes), vector_codes.nearest(values, moved)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
    assert balls.neighbours.mean() < 20  # of 39


def test_codes_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [0.5, -0.25, 1.0, 3.0]
    rows = [
        (1, None, 0), (2, [], 0), (3, [0.0, None, 1.0, 1.0], 0), (4, [nan] * 4, 0), (5, [1.0, inf, 0.0, 0.0], 0),
        (6, good, None), (6, good, None), (None, [1e30, -1e30, 0.0, 0.0], 1), (7, [1.0, 2.0], 1), (8, [0.0] * 4, 1), (9, [1.0] * 3, 1),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    clash = frame.withColumns({c: F.lit("x") for c in ("q", "codes", "far", "v", "id", "n", "most", "of")})
    codes, books = vector_codes.compress(clash, parts=2, entries=2)
    out = vector_codes.label_errors(codes).collect()
    assert Counter(r.vec_id for r in out) == {6: 2, 8: 1, None: 1}
    assert len({r.label_error for r in out if r.label is None}) == 1 and books.shape == (2, 2, 2)
    none, empty = vector_codes.compress(frame.limit(0), parts=2)
    assert none.count() == 0 and vector_codes.codebooks_digest(empty) == hashlib.sha256(b"").hexdigest()


def test_pieces_are_cut_permuted_and_streamed():
    data = "aé中\U0001f600z".encode() * 3
    view = memoryview(data)
    n = piece_table.code_points(view)
    assert n == 15
    for places in ([0, 0], [0, 15], [3, 4], [14, 15], [15, 15], [7, 7]):
        at = piece_table.byte_places(view, n, places)
        assert [data[:a].decode() for a in at] == [data.decode()[:p] for p in places]
        table = piece_table.cut([(0, 0, len(data))], at)
        assert len(table) == 3 and b"".join(piece_table.stream(table, [view])) == data
        order = [2, 0, 1]
        moved = piece_table.arrange(table, order)
        assert piece_table.arrange(moved, piece_table.inverse(order)) == table
        assert piece_table.sha256(table, [view]) == hashlib.sha256(data).hexdigest()


def plain_middle(key, text):
    """The form and output of a text by slices of the string."""
    n = len(text)
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    if not n or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_middles_match_plain_slices_and_come_back(spark):
    rng = random.Random(2)
    letters = "a<PSM>é中\U0001f600 \n"
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 12))) for _ in range(600)] + ["é" * 1_500_000, "<P", "<M>", ">P<"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = fill_middle.restore(fill_middle.fill_middle(frame)).collect()
    forms = Counter()
    made = {r.doc_id: r.output for r in fill_middle.fill_middle(frame).collect()}
    for r in rows:
        form, prefix, middle, output = plain_middle(r.doc_id, texts[r.doc_id])
        assert (r.form, r.prefix_chars, r.middle_chars, made[r.doc_id]) == (form, prefix, middle, output)
        assert r.n == len(texts[r.doc_id]) and r.restored == texts[r.doc_id]
        assert r.output_sha256 == hashlib.sha256(output.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
        forms[form] += 1
    assert len(forms) == 3


def test_middles_of_odd_rows(odd_docs, clashing, no_docs):
    docs = {(r.doc_id, r.text) for r in odd_docs.collect()}
    made = fill_middle.restore(fill_middle.fill_middle(odd_docs))
    rows = made.collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert (r.doc_id, r.restored) in docs or ((r.doc_id, None) in docs and r.restored == "")
    again = fill_middle.fill_middle(clashing, key="n")
    assert again.columns[0] == "n_" and again.count() == odd_docs.count()
    assert fill_middle.fill_middle(no_docs).count() == 0


def test_byte_tokens_equal_the_file():
    rng = random.Random(4)
    encode = byte_tokens.ByteTokenizer(BYTE_BPE)
    letters = "a B1 2  \n\n\t\r'sé  中,.!-<|>‌\x1f\x85\xa0　\U0001f600İ٣"
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(5000)]
    texts += ["", " ", "\n", "<|endoftext|> x", "word " * 10, "a\n\n b", "a \nb", "\n\nx"]
    for text, ids in zip(texts, encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids
    long = "a b\n c  d\te " * 250_000
    assert encode([long])[0] == encode._whole(long)


def check_packed(rows, want, limits, keys):
    """Every id once, in order, within the limits and without gaps."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i in keys:
        ids, at = want[i], 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids) and r.ids == ids[at : at + r.length]
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    fills = []
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= limits.tokens and len(pieces) <= limits.segments and sum(r.loss_tokens for r in pieces) <= limits.loss
        fills.append(at)
    return fills


@pytest.mark.parametrize("limits", [(64, 8, 64), (64, 3, 20), (1024, 256, 1024), (50, 50, 10)])
@pytest.mark.parametrize("cut", [True, False])
def test_examples_are_packed_within_all_limits(spark, limits, cut):
    limits = vector_packing.Limits(*limits)
    rng = random.Random(7)
    rows = [(i, "ask " * int(rng.expovariate(0.1)), "say so " * int(rng.expovariate(0.08))) for i in range(900)]
    rows += [(900, "p " * 500, "x"), (901, "", "r " * 700), (902, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, ask string, text string").repartition(3)
    packed = vector_packing.pack(frame, BYTE_BPE, prompt="ask", limits=limits, cut=cut, with_ids=True)
    encode = byte_tokens.ByteTokenizer(BYTE_BPE)
    whole = lambda t: np.frombuffer(encode([t or ""])[0], "<u4").tolist()
    want = {i: whole(a) + whole(t) + [0] for i, a, t in rows}
    prompts = {i: len(whole(a)) for i, a, _ in rows}
    got = packed.collect()
    fills = check_packed(got, want, limits, want)
    assert all(r.loss_tokens == max(0, r.start + r.length - max(r.start, prompts[r.doc_id])) for r in got)
    if cut:  # no padding at all: a sequence is full or a power of two
        assert all(n == limits.tokens or n & (n - 1) == 0 for n in fills)
        assert vector_packing.padding(packed, limits).first().padded == 0
    else:
        uncut = [i for i in want if len(want[i]) <= limits.tokens and len(want[i]) - prompts[i] <= limits.loss]
        assert max(Counter(r.doc_id for r in got if r.doc_id in uncut).values()) == 1


def test_many_tiny_examples_leave_no_padding(spark):
    frame = spark.createDataFrame([(i, "" if i % 3 else "one two three") for i in range(5000)], "doc_id long, text string").coalesce(1)
    packed = vector_packing.pack(frame, BYTE_BPE, with_ids=True)
    limits = vector_packing.Limits()
    fills = check_packed(packed.collect(), defaultdict(list), limits, [])
    assert sum(fills) == sum(1 if i % 3 else 4 for i in range(5000)) and all(n & (n - 1) == 0 for n in fills)


def test_packing_of_odd_rows(odd_docs, clashing, no_docs):
    rows = vector_packing.pack(odd_docs, BYTE_BPE, with_ids=True).collect()
    encode = byte_tokens.ByteTokenizer(BYTE_BPE)
    tokens = sum(len(encode([r.text or ""])[0]) // 4 + 1 for r in odd_docs.collect())
    assert sum(r.length for r in rows) == tokens
    fills = check_packed(rows, {}, vector_packing.Limits(), [])
    assert all(n & (n - 1) == 0 for n in fills)
    assert vector_packing.pack(clashing, BYTE_BPE).agg(F.sum("length")).first()[0] == tokens
    assert vector_packing.pack(no_docs, BYTE_BPE).count() == 0
    with pytest.raises(ValueError):
        vector_packing.Limits(segments=0)


def test_packing_query_covers_all_documents(spark):
    rows = queries.op13_vector_packing(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    encode = byte_tokens.ByteTokenizer(BYTE_BPE)
    want = {r.doc_id: np.frombuffer(encode([r.text or ""])[0] + b"\0\0\0\0", "<u4") for r in docs}
    pieces = defaultdict(list)
    for r in rows.collect():
        assert r.ids_crc32 == zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes())
        pieces[r.doc_id].append((r.start, r.length))
    for i, ids in want.items():
        spans = sorted(pieces[i])
        assert spans[0][0] == 0 and [a + n for a, n in spans[:-1]] == [a for a, _ in spans[1:]]
        assert sum(spans[-1]) == len(ids)
    assert vector_packing.padding(rows).first().padded == 0
