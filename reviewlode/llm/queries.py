"""The registered queries of this subpackage, with SQL where SQL can give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlode.llm import (
    embedding_dedup,
    fill_middle,
    jaccard_join,
    license_scan,
    lm_scoring,
    mixing,
    packing,
    quality_rules,
    rule_classifier,
    sharding,
    token_rollups,
    vector_codes,
    vector_packing,
)
from reviewlode.llm.common import doc_hash, n_words, table
from reviewlode.session import work_dir

# Runs of letters or digits, and single marks.
TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"

Query = Callable[[SparkSession, str], DataFrame]


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share four fifths of their five-word shingles."""
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document in a mix of all sources."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every document under a context tree and under word counts."""
    docs = table(spark, sf_dir, "documents")
    scored = lm_scoring.score(docs)
    return scored.withColumn("held_out", lm_scoring.held_out("doc_id"))


def op4_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after all documents came in, were counted again by a new tokenizer version, and short ones went.

    Every batch is committed twice, which must not change a total.
    """
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    new = F.regexp_count(text, F.lit(TOKEN)).cast("long")
    rows = docs.select(
        "source", "lang", n_words(text).alias("n"), new.alias("m"), F.octet_length(text).cast("long").alias("n_bytes")
    )

    def changes(op: str, tokenizer: str, n: str, old: str | None = None, old_n: str | None = None) -> DataFrame:
        before = {
            "old_source": F.col("source"),
            "old_lang": F.col("lang"),
            "old_tokenizer": F.lit(old),
            "old_n_tokens": F.col(old_n) if old_n else F.lit(0),
            "old_n_bytes": F.col("n_bytes") if old else F.lit(0),
        }
        now = rows.withColumns(before)
        return now.withColumn("op", F.lit(op)).withColumn("tokenizer", F.lit(tokenizer)).withColumn("n_tokens", F.col(n))

    rollup = token_rollups.Rollup(spark, f"{work_dir(spark)}/{spark.sparkContext.applicationId}/rollup-{uuid.uuid4().hex}")
    batches = {
        "1-insert": changes("insert", "words-1", "n"),
        "2-revise": changes("revise", "marks-2", "m", "words-1", "n"),
        "3-delete": changes("delete", "marks-2", "m").where("n < 10"),
    }
    for name in [*batches, *batches]:
        rollup.commit(name, batches[name])
    return rollup.totals()


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence and place of every piece of every document."""
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document, its path being source, language and a place in a tree of folders."""
    docs = table(spark, sf_dir, "documents")
    # Two levels of folders, as many as the documents ask for.
    place = F.expr("concat_ws('/', coalesce(source, '-'), coalesce(lang, '-'), doc_id div 1000, doc_id div 20 % 50, doc_id)")
    return license_scan.scan(docs.select("doc_id", "text", place.alias("path")))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and verdict of every vector."""
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document after a global shuffle."""
    shuffled = sharding.shard_rows(table(spark, sf_dir, "documents"))
    return shuffled.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, statistics and verdict of every document."""
    return quality_rules.verdicts(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    model = rule_classifier.train(docs, table(spark, sf_dir, "labels"))
    held_out = F.pmod(doc_hash(F.col("doc_id")), F.lit(3)) == 1
    scored = rule_classifier.classify(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every vector, the error of its label, and the codebooks' digest."""
    codes, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    out = vector_codes.label_errors(codes)
    code, digest = F.lower(F.hex("codes")), F.lit(vector_codes.codebooks_digest(books))
    return out.select(
        "vec_id", code.alias("code"), F.col("far").alias("error"), "label_error", digest.alias("codebooks_sha256")
    )


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-the-middle form of every document, and the text that its output gives back, as digests."""
    made = fill_middle.fill_middle(table(spark, sf_dir, "documents"))
    return fill_middle.restore(made, with_text=False)


def op13_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence and place of every piece of every document under limits on tokens, segments and loss."""
    import public_tokenizers

    packed = vector_packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return packed.select(*names, "loss_tokens")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_mixing,
        op3_lm_scoring,
        op4_token_rollups,
        op5_best_fit_packing,
        op6_quality_rules,
        op7_license_scan,
        op8_embedding_dedup,
        op9_sharding,
        op10_quality_classifier,
        op11_vector_codes,
        op12_fill_middle,
        op13_vector_packing,
    )
}


def _codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """The codes by plain comparison with all entries."""
    steps = [
        f"""
        with kept as (
            select row_number() over (order by vec_id) as r, vec_id, label,
                list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q
            from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), parts as (
            select r, vec_id, label, p, len(q) // {parts} as w, q[p * (len(q) // {parts}) + 1 : (p + 1) * (len(q) // {parts})] as x
            from kept, range({parts}) t(p)
        ), book0 as (select p, r - 1 as e, x as c from parts where r <= {entries})"""
    ]
    distance = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for i in range(rounds + 1):
        steps.append(
            f"""far{i} as (
            select r, p, e, cast({distance} as bigint) as d from parts join book{i} using (p)
        ), best{i} as (
            select r, p, d, e from far{i} qualify row_number() over (partition by r, p order by d, e) = 1
        )"""
        )
        if i < rounds:
            steps.append(
                f"""mean{i} as (
            select p, e, list(m order by j) as m from (
                select p, e, j, cast(floor(sum(x[j]) / count(*)) as bigint) as m
                from best{i} join parts using (r, p), range(1, 1 + (select max(w) from parts)) t(j) group by p, e, j
            ) group by p, e
        ), book{i + 1} as (select p, e, coalesce(m, c) as c from book{i} left join mean{i} using (p, e))"""
            )
    return ", ".join(steps) + f""", coded as (
            select r, string_agg(printf('%02x', e), '' order by p) as code, cast(sum(d) as bigint) as error
            from best{rounds} group by r
        ), digest as (
            select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) as codebooks_sha256 from book{rounds}
        )
        select vec_id, code, error,
            cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256
        from coded join kept using (r), digest
    """

SQL: dict[str, str] = {
    "op4_token_rollups": rf"""
        with counted as (
            select source, lang, coalesce(text, '') as t from documents
        ), kept as (
            select source, lang, t from counted
            where len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) >= 10
        )
        select source, lang, 'marks-2' as tokenizer, count(*) as n_docs,
            cast(sum(len(regexp_extract_all(t, '{TOKEN}'))) as bigint) as n_tokens,
            cast(sum(strlen(t)) as bigint) as n_bytes
        from kept group by source, lang
    """,
    "op11_vector_codes": _codes_sql(),
    "op12_fill_middle": r"""
        with hashed as (
            select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents
        ), numbers as (
            select doc_id, t, cast(length(t) as bigint) as n, cast('0x' || h[1:8] as bigint) as h1,
                cast('0x' || h[9:16] as bigint) as h2, cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4
            from hashed
        ), cuts as (
            select doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
                case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain'
                    when h4 % 100 < 20 then 'spm' else 'psm' end as form
            from numbers
        ), parts as (
            select *, substring(t, 1, a) as prefix, substring(t, a + 1, b - a) as middle, substring(t, b + 1) as suffix from cuts
        )
        select doc_id, n, form,
            case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
            sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
            sha256(t) as restored_sha256
        from parts
    """,
}
