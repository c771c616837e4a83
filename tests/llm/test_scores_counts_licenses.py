import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from reviewlode.llm import context_tree, license_scan, lm_scoring, token_rollups


def plain_tree(train, depth):
    """Decision trees over contexts as dicts: (context, decision) → [zeros, ones]."""
    counts = defaultdict(lambda: [0, 0])
    for data in train:
        padded = bytes([10]) * depth + data
        for i in range(depth, len(padded)):
            for d in range(depth + 1):
                context = padded[i - d : i]
                for level in range(8):
                    node = (1 << level) | (padded[i] >> (8 - level))
                    counts[context, node][(padded[i] >> (7 - level)) & 1] += 1
    return counts


def log_kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)


def plain_scores(train, texts, depth):
    counts = plain_tree(train, depth)
    children = defaultdict(list)
    for context, node in counts:
        if context:
            children[context[1:], node].append((context, node))
    worth = {}
    for at in sorted(counts, key=lambda x: -len(x[0])):
        own = log_kt(*counts[at])
        below = sum(worth[c] for c in children[at])
        worth[at] = own if len(at[0]) == depth else np.logaddexp(math.log(0.5) + own, math.log(0.5) + below)
    out = []
    for data in texts:
        padded, total = bytes([10]) * depth + data, 0.0
        for i in range(depth, len(padded)):
            for level in range(8):
                node, bit = (1 << level) | (padded[i] >> (8 - level)), (padded[i] >> (7 - level)) & 1
                p = 0.5
                for d in range(depth, -1, -1):
                    at = (padded[i - d : i], node)
                    if at in counts:
                        own = (counts[at][bit] + 0.5) / (sum(counts[at]) + 1)
                        share = 1.0 if d == depth else math.exp(math.log(0.5) + log_kt(*counts[at]) - worth[at])
                        p = share * own + (1 - share) * p
                total += math.log10(p)
        out.append(total)
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    parts = ["an", "the", "ion", "er", "é", "st", "A"]
    made = [" ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(rng.randint(0, 25))) for _ in range(60)]
    return [*made, None, "", "  ", made[0], "unseen zzz \U0001f600"]


@pytest.mark.parametrize("head", [lm_scoring.HEAD, 20])
def test_scores_match_a_plain_tree(make_docs, texts, head):
    rows = {r.doc_id: r for r in lm_scoring.score(make_docs(texts), depth=3, head=head).collect()}
    coded = [context_tree.code(t)[0] for t in texts]
    learned = [c for i, c in enumerate(coded) if zlib.crc32(str(i).encode()) % 10]
    tokens = [[*c[:-1].split(), b"\n"] for c in coded]
    counts = Counter(w for i, t in enumerate(tokens) if zlib.crc32(str(i).encode()) % 10 for w in t)
    n = sum(counts.values())
    for i, want in enumerate(plain_scores(learned, coded, 3)):
        row = rows[i]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (len(counts) + 1))) for w in tokens[i])
        assert (row.n_tokens, row.train_tokens) == (len(tokens[i]), n)
        assert row.n_known == sum(counts[w] > 0 for w in tokens[i])
        assert abs(row.score - want) < 1e-6 and abs(row.base_score - base) < 1e-6


def test_probabilities_of_all_next_bytes_sum_to_one():
    data = [context_tree.code(t)[0] for t in ("an ion and the ion", "the anion", "")]
    grams, counts = np.unique(context_tree.grams_of(data, 3)[0], return_counts=True)
    nodes = context_tree.subtree(grams, counts, 3, 0)
    for context in (int(grams[3]) >> 8, 0x414243):
        every = (context << 8) | np.arange(256)
        assert abs((10 ** context_tree.log_probability(every, 3, nodes)).sum() - 1) < 1e-9


def test_scores_of_odd_rows(odd_docs, clashing, no_docs):
    plain = sorted(r.score for r in lm_scoring.score(odd_docs, depth=2).collect())
    assert plain == pytest.approx(sorted(r.score for r in lm_scoring.score(clashing, depth=2).collect()))
    blind = lm_scoring.score(odd_docs, depth=2, learn=F.lit(False)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 for r in blind)
    assert min(abs(r.score - 8 * math.log10(0.5)) for r in blind) < 1e-9
    assert lm_scoring.score(no_docs, depth=2).count() == 0


CHANGE = (
    "op string, source string, lang string, tokenizer string, n_tokens long, n_bytes long, old_source string, "
    "old_lang string, old_tokenizer string, old_n_tokens long, old_n_bytes long, extra string"
)


def test_rollup_commits_once_and_adds_up(spark, tmp_path):
    rng = random.Random(4)
    state, batches = {}, []
    for b in range(3):
        changes = []
        for _ in range(80):
            key = rng.randrange(40)
            new = (rng.choice(["s", "", None]), rng.choice(["en", None]), rng.choice(["v1", "v2"]), rng.randrange(9), rng.choice([None, 5]))
            if key not in state:
                changes.append(("insert", *new, *[None] * 5, "x"))
                state[key] = new
            elif rng.random() < 0.4:
                changes.append(("DELETE", *state.pop(key), *[None] * 5, "x"))
            else:
                changes.append(("revise", *new, *state[key], "x"))
                state[key] = new
        batches.append(spark.createDataFrame(changes, CHANGE))
    rollup = token_rollups.Rollup(spark, str(tmp_path / "rollup"))
    assert rollup.totals().count() == 0
    assert [rollup.commit(str(b), batches[b]) for b in (2, 0, 0, 1, 2)] == [True, True, False, True, False]
    want = defaultdict(lambda: [0, 0, 0])
    for source, lang, tokenizer, n, size in state.values():
        want[source, lang, tokenizer][0] += 1
        want[source, lang, tokenizer][1] += n
        want[source, lang, tokenizer][2] += size or 0
    got = {tuple(r)[:3]: list(r)[3:] for r in rollup.totals().collect()}
    assert got == {k: v for k, v in want.items()}
    assert rollup.batches() == ["0", "1", "2"]


def test_a_batch_without_its_mark_is_written_anew(spark, tmp_path):
    rollup = token_rollups.Rollup(spark, str(tmp_path / "rollup"))
    rows = spark.createDataFrame([("insert", "s", "en", "v", 3, 4, *[None] * 5, "x")], CHANGE)
    rollup.commit("a", rows)
    (tmp_path / "rollup" / "batch=a" / "_SUCCESS").unlink()
    assert rollup.totals().count() == 0
    assert rollup.commit("a", rows)
    assert [tuple(r) for r in rollup.totals().collect()] == [("s", "en", "v", 1, 3, 4)]
    assert rollup.commit("empty", rows.limit(0)) and rollup.totals().count() == 1
    with pytest.raises(ValueError):
        rollup.commit("../x", rows)
    with pytest.raises(PySparkException):
        rollup.commit("bad", rows.withColumn("op", F.lit("drop")))


def plain_licenses(texts, threshold=license_scan.THRESHOLD):
    """Best (license, whole) of every text by comparing every line and the whole with every template."""
    import re

    def terms(x):
        return re.findall(license_scan.TERM, x.lower())

    df = Counter(t for x in texts for t in set(terms(x or "")))
    vocabulary = {t for _, x in license_scan.TEMPLATES for t in terms(x)}
    idf = {t: math.log((len(texts) + 1) / (df[t] + 1)) + 1 for t in vocabulary}
    other = max(idf.values())

    def vector(ts):
        v = {t: (1 + math.log(n)) * idf.get(t, other) for t, n in Counter(ts).items()}
        length = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / length for t, x in v.items()} if length else {}

    templates = {name: vector(terms(x)) for name, x in license_scan.TEMPLATES}
    out = []
    for text in texts:
        lines = (text or "").split("\n")
        best = (threshold - 1e-9, False, None)
        for whole, part in [*((len(lines) == 1, x) for x in lines), (True, text or "")]:
            v = vector(terms(part))
            for name, t in sorted(templates.items()):
                cosine = sum(x * t.get(k, 0) for k, x in v.items())
                if (round(cosine, 9), whole) > (round(best[0], 9), best[1]):
                    best = (cosine, whole, name)
        out.append((best[2], best[1] if best[2] else None))
    return out


def test_licenses_match_all_comparisons_and_go_down(spark):
    rng = random.Random(6)
    words = "the a of in version source code under terms public work use is by file blue green red".split()
    texts, paths = [], []
    for i in range(120):
        lines = [" ".join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(rng.randint(1, 4))]
        if i % 5 == 0:
            lines.insert(rng.randrange(len(lines)), rng.choice(license_scan.TEMPLATES)[1])
        if i % 17 == 0:
            lines = [rng.choice(license_scan.TEMPLATES)[1].upper()]
        texts.append("\n".join(lines))
        paths.append("/".join([*rng.choices("abc", k=rng.randint(0, 3)), f"f{i}"]))
    texts += [None, "", "copyright"]
    paths += ["a/x", None, "q"]
    rows = list(enumerate(zip(texts, paths, strict=True)))
    table = spark.createDataFrame([(i, t, p, "x", 1.0) for i, (t, p) in rows], "doc_id long, text string, path string, license string, cosine double")
    got = {r.doc_id: r for r in license_scan.scan(table).collect()}
    own = plain_licenses(texts)
    best = {}
    for i, (name, whole) in enumerate(own):
        if whole and paths[i] is not None:
            folder = paths[i].rpartition("/")[0]
            best[folder] = max(best.get(folder, (0, "")), (got[i].cosine, name))
    for i, (name, whole) in enumerate(own):
        if name:
            assert (got[i].license, got[i].origin) == (name, "file" if whole else "header"), texts[i]
            continue
        folder, found = paths[i], None
        while folder and found is None:
            folder = folder.rpartition("/")[0]
            found = best.get(folder, (0, None))[1]
        assert (got[i].license, got[i].origin) == (found, "inherited" if found else "none")
    assert any(r.origin == "inherited" for r in got.values()) and len(got) == len(texts)
    assert license_scan.scan(table.limit(0)).count() == 0


def test_licenses_of_odd_rows(odd_docs):
    files = odd_docs.withColumn("path", F.concat(F.lit("x/"), F.col("doc_id").cast("string")))
    rows = license_scan.scan(files).collect()
    assert len(rows) == odd_docs.count() and {r.origin for r in rows} == {"none"}


def test_real_licence_files_and_wrapped_headers(spark):
    full = {name: text for name, text, whole in license_scan.LONGER if whole}
    header = dict(license_scan.HEADERS)["gpl-3.0"].split()
    wrapped = "\n".join("# " + " ".join(header[i : i + 9]) for i in range(0, len(header), 9))
    code = "\n".join(f"value{i} = compute{i}(other{i}, {i})" for i in range(200))
    rows = [(f"{name}/LICENSE", text) for name, text in full.items()]
    rows += [("titled/LICENSE", "MIT License\n\nCopyright (c) 2020 A Person\n\n" + full["mit"]), ("titled/sub/code", code)]
    rows += [("x/a", wrapped + "\n" + code), ("x/b", "// SPDX-License-Identifier: MPL-2.0\n" + code), ("x/c", code)]
    rows += [("x/d", code + "\n" + full["bsd-3-clause"] + "\n" + code)] * 2
    rows += [(f"y/{i}", code + f" word{i}") for i in range(60)]
    table = spark.createDataFrame([(p, p, t) for p, t in rows], "doc_id string, path string, text string")
    got = {r.path: (r.license, r.origin) for r in license_scan.scan(table).collect()}
    for name in full:
        assert got[f"{name}/LICENSE"] == (name, "file")
    assert got["titled/LICENSE"] == ("mit", "file") and got["titled/sub/code"] == ("mit", "inherited")
    assert got["x/a"] == ("gpl-3.0", "header") and got["x/b"] == ("mpl-2.0", "header")
    assert got["x/d"] == ("bsd-3-clause", "header") and got["x/c"] == (None, "none")
