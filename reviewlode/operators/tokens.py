"""Stop words, lexicon annotation, vocabulary and id sequences."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, StructField, StructType

from reviewlode.functions import text as X
from reviewlode.operators.blocks import in_blocks, lookup_words, surface_of_blocks, words_of_blocks
from reviewlode.operators.skew import lookup_join, number_rows
from reviewlode.operators.surface import kinds, surface_tokens
from reviewlode.session import land

# A stop list up to this size becomes a literal set; a longer one is joined.
STOP_LITERALS = 20_000

UNKNOWN_TAG = "X"

# Size of the blocks that words are looked up in: bytes of text, and words.
BLOCK_BYTES, BLOCK_WORDS = 8 << 20, 1 << 20

# Characters of text that a user's tagger gets at a time.
TAGGED_CHARS = 1 << 18

ANNOTATED = "array<struct<sent:int,pos:int,text:string,lemma:string,upos:string>>"


def _short_list(words: DataFrame, limit: int) -> list[str] | None:
    """The distinct words, or nothing when there are more than ``limit``."""
    rows = words.select("word").distinct().limit(limit + 1).collect()
    return sorted(row.word for row in rows if row.word is not None) if len(rows) <= limit else None


def word_list(words: DataFrame, limit: int = STOP_LITERALS) -> list[str]:
    """The distinct words of a list of checked size."""
    listed = _short_list(words, limit)
    if listed is None:
        raise ValueError(f"more than {limit} words: use remove_words, which joins long lists")
    return listed


def remove_words(
    df: DataFrame, tokens: str, stop: DataFrame, key: str = "review_id", limit: int = STOP_LITERALS
) -> DataFrame:
    """Drop stop words from an array column; order and duplicates of kept words stay, null stays null.

    A short list becomes a set inside the expression. A long one is joined to the exploded words,
    with frequent words spread over tasks, and the rest is put back in order per row.
    """
    short = _short_list(stop, limit)
    if short is not None:
        return df.withColumn(tokens, X.keep_words(F.col(tokens), short))
    listed = land(stop.select(F.col("word").alias("_w")).distinct(), "stop")
    # Stored row numbers tell rows apart whose keys are null or equal.
    placed = land(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
    exploded = words_of(placed, tokens, "_row", "_pos", "_w")
    flagged = lookup_join(
        exploded, listed.withColumn("_stop", F.lit(True)), "_w", "left", spread_by=["_row", "_pos"]
    )
    kept = flagged.filter(F.col("_stop").isNull())
    arrays = kept.groupBy("_row").agg(_in_order(F.struct("_pos", "_w"), "_w").alias("_kept"))
    empty = F.array().cast(df.schema[tokens].dataType)
    left = F.when(F.col(tokens).isNotNull(), F.coalesce("_kept", empty))
    return placed.join(arrays, "_row", "left").withColumn(tokens, left).select(*df.columns)


def _in_order(entry: Column, field: str) -> Column:
    """Entries of a row, sorted by their first field, as an array of ``field``."""
    return F.transform(F.array_sort(F.collect_list(entry)), lambda t: t[field])


def best_entries(lexicon: DataFrame) -> DataFrame:
    """One entry per token: the most frequent, then the greatest (lemma, tag)."""
    best = F.max(F.struct("freq", "lemma", "upos"))
    return lexicon.groupBy("token").agg(best.alias("_best")).select("token", "_best.lemma", "_best.upos")


def annotate(
    df: DataFrame, lexicon: DataFrame, column: str = "comment", key: str = "review_id"
) -> DataFrame:
    """``key, tokens``: each word with lemma and tag from the lexicon, in text order.

    Unknown words keep their text as lemma and get the tag ``X``. Texts without words give an empty
    array. Words are looked up block by block, see :mod:`blocks`.
    """
    schema = StructType([df.schema[key], StructField("tokens", DataType.fromDDL(ANNOTATED))])
    table_of = kinds(df.sparkSession)

    def find(texts: pa.Table, known: pa.Table) -> pa.Table:
        surface = surface_tokens(texts[column].combine_chunks(), table_of)
        word = surface.words
        at = pc.index_in(word, value_set=known["token"].combine_chunks())
        lemma = pc.coalesce(known["lemma"].combine_chunks().take(at), word)
        upos = pc.coalesce(known["upos"].combine_chunks().take(at), pa.scalar(UNKNOWN_TAG, word.type))
        values = [pa.array(surface.sent), pa.array(surface.pos), word, lemma, upos]
        found = pa.StructArray.from_arrays(values, ["sent", "pos", "text", "lemma", "upos"])
        tokens = pa.ListArray.from_arrays(pa.array(surface.starts), found)
        return pa.table([texts[key], tokens], names=[key, "tokens"])

    blocks = in_blocks(df.select(key, column), F.octet_length(column), BLOCK_BYTES)
    held = surface_of_blocks(blocks, column)
    return lookup_words(blocks, held, best_entries(lexicon), [F.col(key), F.col(column)], find, schema)


def _offsets(lengths: pa.Array) -> np.ndarray:
    """Where lists of these lengths begin, and the end of the last one."""
    return np.concatenate([[0], np.cumsum(lengths.to_numpy(zero_copy_only=False))]).astype(np.int32)


def annotate_with(
    df: DataFrame,
    tagger: Callable[[pd.Series], pd.Series],
    column: str = "comment",
    key: str = "review_id",
) -> DataFrame:
    """The same table from a user's own tagger.

    ``tagger`` gets a batch of texts and returns, per text, a list of
    ``(sent, pos, text, lemma, upos)`` tuples. It is applied inside the tasks, to texts of about
    ``TAGGED_CHARS`` characters at a time, so that a task never holds the tuples of more.
    """

    def tag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fields = ("sent", "pos", "text", "lemma", "upos")
        for batch in batches:
            chars = batch[column].str.len().fillna(0).cumsum()
            for _, part in batch.groupby((chars // TAGGED_CHARS).to_numpy(), sort=False):
                part = part.reset_index(drop=True)
                tagged = tagger(part[column])
                yield pd.DataFrame(
                    {
                        key: part[key].to_numpy(),
                        "tokens": [[dict(zip(fields, t)) for t in row] for row in tagged],
                    }
                )

    key_type = df.schema[key].dataType.simpleString()
    return df.select(key, column).mapInPandas(tag, f"{key} {key_type}, tokens {ANNOTATED}")


def lemma_text(tokens: Column) -> Column:
    """Lemmas of an annotated text, joined by blanks."""
    return X.join_words(F.transform(tokens, lambda t: t["lemma"]))


def clean_lemma(
    df: DataFrame, lexicon: DataFrame, column: str = "comment", key: str = "review_id"
) -> DataFrame:
    """``key, column``: training clean, then every word replaced by its lemma."""
    cleaned = df.select(key, X.clean_train(F.col(column)).alias(column))
    return annotate(cleaned, lexicon, column, key).select(key, lemma_text(F.col("tokens")).alias(column))


def words_of(df: DataFrame, tokens: str, key: str, pos: str = "pos", word: str = "token") -> DataFrame:
    """``key, pos, word``: one row per entry of an array column."""
    exploded = df.select(key, X.explode_words(tokens, pos, word))
    return exploded.filter(F.col(word).isNotNull())


def token_counts(df: DataFrame, tokens: str = "tokens", key: str = "review_id") -> DataFrame:
    """``token, count`` with the place where each token is first seen."""
    return words_of(df, tokens, key).groupBy("token").agg(
        F.count(F.lit(1)).alias("count"),
        F.min(X.place(F.col(key), F.col("pos"))).alias("first_seen"),
    )


def build_vocab(df: DataFrame, tokens: str = "tokens", key: str = "review_id") -> DataFrame:
    """``token, count, id``: ids from 1, most frequent first, ties by first appearance."""
    counts = token_counts(df, tokens, key)
    order = [F.desc("count"), F.col("first_seen"), F.col("token")]
    return number_rows(counts, order, "id").select("token", "count", "id")


def encode_tokens(
    df: DataFrame, vocab: DataFrame, tokens: str = "tokens", key: str = "review_id", name: str = "ids"
) -> DataFrame:
    """Replace tokens by vocabulary ids, in order; unknown tokens are dropped, null arrays become empty.

    Tokens are looked up block by block, see :mod:`blocks`.
    """
    schema = StructType([df.schema[key], StructField(name, ArrayType(IntegerType()))])

    def find(texts: pa.Table, known: pa.Table) -> pa.Table:
        lists = texts["_tokens"].combine_chunks()
        at = pc.index_in(lists.flatten(), value_set=known["token"].combine_chunks())
        found = known["_ids"].combine_chunks().take(at)
        ids = found.flatten()
        ends = _offsets(pc.fill_null(pc.list_value_length(found), 0))[_offsets(pc.list_value_length(lists))]
        return pa.table([texts[key], pa.ListArray.from_arrays(pa.array(ends), ids)], names=[key, name])

    entries = vocab.groupBy("token").agg(F.sort_array(F.collect_list(F.col("id").cast("int"))).alias("_ids"))
    blocks = in_blocks(df.select(key, tokens), F.greatest(F.size(tokens), F.lit(0)), BLOCK_WORDS)
    whole = F.coalesce(tokens, F.array().cast(df.schema[tokens].dataType)).alias("_tokens")
    return lookup_words(blocks, words_of_blocks(blocks, tokens), entries, [F.col(key), whole], find, schema)


def max_len(df: DataFrame, ids: str = "ids") -> DataFrame:
    """Length of the longest sequence."""
    return df.agg(F.max(F.size(ids)).alias("max_len"))


def pad_sequences(df: DataFrame, ids: str = "ids", length: int | None = None) -> DataFrame:
    """Pad every sequence in front to ``length``, by default that of the longest."""
    if length is None:
        length = max_len(df, ids).first()[0] or 0
    return df.withColumn(ids, X.pad_left(F.col(ids), length) if length else F.col(ids))


def dynamic_min_df(df: DataFrame) -> DataFrame:
    """Minimum document frequency for topic models: 2 % of the corpus, at least 2."""
    return df.agg(F.greatest(F.lit(2).cast("long"), F.floor(F.count(F.lit(1)) / 50)).alias("min_df"))


def df_bounds(n: int, min_df: float, max_df: float) -> tuple[int, int]:
    """Document-frequency limits as counts: whole numbers count documents, fractions are shares."""
    low = min_df if isinstance(min_df, int) else min_df * n
    high = max_df if isinstance(max_df, int) else max_df * n
    return low, high


def doc_freq(
    df: DataFrame,
    terms: str = "tokens",
    min_df: float = 1,
    max_df: float = 1.0,
    n: int | None = None,
) -> DataFrame:
    """``term, df`` for terms within both limits (inclusive); ``n`` is the number of rows if known."""
    counts = (
        df.select(F.explode(F.array_distinct(terms)).alias("term"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"))
    )
    low, high = df_bounds(df.count() if n is None else n, min_df, max_df)
    return counts.filter((F.col("df") >= low) & (F.col("df") <= high))
