import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from reviewlode.operators import cleaning, clusters, grouping, merging, sampling, skew
from reviewlode.session import fits_broadcast, land, work_dir

# Published counts of raw room types and of their groups.
RAW_COUNTS = {
    "ویلا": 22394, "آپارتمان": 12420, "سوئیت": 4871, "خانه": 3457, "بوم گردی": 3136, "کلبه": 2468,
    "سوییت": 2385, "اقامتگاه": 1255, "اقامتگاه سنتی": 991, "هتل": 859, "مجتمع اقامتگاهی": 724,
    "مهمانسرا": 398, "هاستل": 305, "مسافرخانه": 242, "روستایی": 69, "کاروانسرا": 49,
}
GROUP_COUNTS = {
    "خانه": 25920, "آپارتمان_سوئیت": 19676, "اقامتگاه_بومگردی": 6795, "کلبه": 2468, "هتل": 1164,
}


def test_room_type_golden_counts(spark):
    raw = spark.createDataFrame(list(RAW_COUNTS.items()), "room_type string, n int")
    rows = raw.select("room_type", F.explode(F.array_repeat(F.lit(0), F.col("n"))).alias("x")).withColumn(
        "review_id", F.monotonically_increasing_id()
    )
    assert rows.count() == 56023
    assert {r["room_type"]: r["count"] for r in grouping.value_counts(rows, "room_type").collect()} == RAW_COUNTS
    counts = grouping.value_counts(grouping.group_room_types(rows), "room_type").collect()
    assert [(r["room_type"], r["count"]) for r in counts] == list(GROUP_COUNTS.items())


def test_unknown_room_types_stay_with_null(spark):
    values = ["بوم‌گردی", "N/A", None, " ويلا\t"]
    rows = spark.createDataFrame(list(enumerate(values)), "review_id int, room_type string")
    grouped = grouping.group_room_types(rows).orderBy("review_id").collect()
    assert [r.room_type for r in grouped] == [None, None, None, "خانه"]


def test_last_group_wins_when_inverting(spark):
    mapping = grouping.mapping_table(spark, {"g1": ["a", "b"], "g2": ["b", "c"]})
    assert {r.value: r.group for r in grouping.invert_mapping(mapping).collect()} == {"a": "g1", "b": "g2", "c": "g2"}


KEYS = ["page", "comment"]


def joined_bag(left, right):
    a, b = Counter(left), Counter(right)
    return Counter({k: a[k] * b[k] if a[k] and b[k] else a[k] + b[k] for k in a.keys() | b.keys()})


def test_merge_fixture(spark):
    left = [(1, "x"), (1, "x"), (None, "y")]
    right = [(1, "x"), (1, "x"), (None, "y"), (2, "z")]
    a, b = (spark.createDataFrame(r, "page int, comment string") for r in (left, right))
    assert Counter(map(tuple, merging.merge_sources(a, b, KEYS).collect())) == Counter(
        {(1, "x"): 4, (None, "y"): 1, (2, "z"): 1}
    )


@pytest.mark.parametrize("step", [1, 7, 10_000])
def test_merge_multiplicity(spark, monkeypatch, step):
    monkeypatch.setattr(merging, "EXPAND_STEP", step)
    rng = random.Random(step)
    rows = lambda n: [(rng.choice([1, 2, 3, None]), rng.choice(["x", "y", None])) for _ in range(n)]
    left, right = rows(40) + [(9, "left")] * 23, rows(40) + [(8, "right")] * 15
    a, b = (spark.createDataFrame(r, "page int, comment string") for r in (left, right))
    assert Counter(map(tuple, merging.merge_sources(a, b, KEYS).collect())) == joined_bag(left, right)
    ordered = [tuple(r) for r in merging.merge_sources(a, b, KEYS, ordered=True).collect()]
    assert ordered == sorted(ordered, key=lambda r: tuple((v is not None, v) for v in r))


def test_filters_are_idempotent(spark):
    texts = ["عالی", "عالیه", None, "wifi ضعیف", "اینترنت ضعیف", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "comment string")
    once = cleaning.clean_comments(rows)
    assert sorted(r.comment for r in once.collect()) == ["اینترنت ضعیف", "عالیه"]
    assert cleaning.clean_comments(once).count() == 2


def test_slices(spark):
    rows = spark.createDataFrame(
        [("a", "SAD", "x"), ("a", "HAPPY", None), (None, "SAD", "y"), ("b", "SAD", "z")],
        "room_type string, sentiment string, comment string",
    )
    assert [r.comment for r in cleaning.by_sentiment(rows, "SAD").collect()] == ["x", "y", "z"]
    assert cleaning.by_group(rows, "a").count() == 1
    assert cleaning.by_group(rows, "b", "HAPPY").count() == 0
    assert {r.room_type for r in grouping.distinct_values(rows, "room_type").collect()} == {"a", "b", None}


# --- skew ------------------------------------------------------------------------------------


def hot_rows(spark, n=3000):
    """One key on a third of the rows, nulls on another part, the rest spread."""
    key = (
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 50))
    )
    return spark.range(n).withColumn("key", key)


@pytest.mark.parametrize("how", ["left", "inner"])
def test_salted_join_equals_broadcast_join(spark, how):
    left = hot_rows(spark)
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k8", 3), ("none", 4)], "key string, v int")
    small = skew.lookup_join(left, right, "key", how, spread_by=["id"])
    large = skew.lookup_join(left, right, "key", how, spread_by=["id"], max_rows=0)
    assert Counter(map(tuple, small.select("id", "key", "v").collect())) == Counter(
        map(tuple, large.select("id", "key", "v").collect())
    )


def test_hot_key_is_spread_over_tasks(spark):
    """A third of the rows share one key; no task of the join gets much more than its even part."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        right = spark.createDataFrame([("hot", 1)], "key string, v int")
        joined = skew.lookup_join(hot_rows(spark), right, "key", "inner", spread_by=["id"], max_rows=0)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for name in settings:
            spark.conf.unset(name)
    assert len(sizes) == 4 and max(sizes) < 2 * min(sizes)


def test_heavy_keys_are_bounded(spark):
    heavy = [r.key for r in skew.heavy_keys(hot_rows(spark), "key", 5).collect()]
    assert len(heavy) == 5 and "hot" in heavy and None not in heavy


def test_number_rows(spark):
    rows = spark.range(1000).select(F.col("id"), (F.col("id") * 7919 % 1009).alias("v"))
    numbered = skew.number_rows(rows.repartition(6), [F.desc("v"), F.col("id")])
    want = sorted(((i * 7919 % 1009, i) for i in range(1000)), key=lambda r: (-r[0], r[1]))
    got = [(r.v, r.id) for r in numbered.orderBy("row_number").collect()]
    assert got == want
    assert numbered.agg(F.min("row_number"), F.max("row_number")).first()[:] == (1, 1000)
    assert skew.number_rows(rows.filter("id < 0"), [F.col("id")]).count() == 0


def test_broadcast_needs_a_proven_size(spark):
    assert fits_broadcast(spark.range(10), 10)
    assert not fits_broadcast(spark.range(11), 10)
    wide = spark.createDataFrame([("x" * 1000,)], "t string")
    assert not fits_broadcast(wide, 10, 500)


def test_landed_table(spark):
    df = spark.range(5).withColumn("p", F.col("id") % 2)
    landed = land(df, "t", partition_by=["p"])
    assert landed.columns == df.columns and sorted(r.id for r in landed.collect()) == list(range(5))
    assert landed.filter("p = 1").count() == 2
    assert landed.inputFiles()[0].replace("file://", "").startswith(work_dir(spark))


# --- samples and folds -----------------------------------------------------------------------


@pytest.mark.parametrize("fraction, size", [(0.1, 50), (0.333, 166), (0.0, 0), (1, 500), (0.002, 1)])
def test_sample_has_exact_size(spark, fraction, size):
    rows = spark.range(500).withColumnRenamed("id", "review_id")
    sample = sampling.sample_fraction(rows, fraction)
    assert sample.count() == size
    if 0 < size < 500:
        again = sampling.sample_fraction(rows.repartition(7), fraction)
        assert {r.review_id for r in sample.collect()} == {r.review_id for r in again.collect()}
        other = sampling.sample_fraction(rows, fraction, seed=1)
        assert {r.review_id for r in other.collect()} != {r.review_id for r in sample.collect()}


def test_split_is_a_partition(spark):
    rows = spark.range(101).withColumnRenamed("id", "review_id")
    train, test = sampling.split(rows, 0.2)
    assert (train.count(), test.count()) == (80, 21)
    assert train.join(test, "review_id").count() == 0


def test_contiguous_folds(spark):
    rows = spark.range(11).withColumnRenamed("id", "review_id")
    folds = sampling.assign_folds(rows, 3).orderBy("review_id").collect()
    assert [r.fold for r in folds] == [0] * 4 + [1] * 4 + [2] * 3


def test_stratified_folds(spark):
    rows = spark.range(103).select(
        F.col("id").alias("review_id"), F.when(F.col("id") % 10 == 0, "SAD").otherwise("HAPPY").alias("label")
    )
    folds = sampling.assign_folds(rows, 5, by="label")
    assert folds.count() == 103
    sizes = [r["count"] for r in folds.groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1
    for row in folds.groupBy("label").pivot("fold").count().collect():
        assert max(row[1:]) - min(row[1:]) <= 1
    in_order = [r.fold for r in folds.filter("label = 'SAD'").orderBy("review_id").collect()]
    assert in_order == sorted(in_order)


# --- clusters --------------------------------------------------------------------------------


def test_cluster_words(spark):
    rows = spark.createDataFrame(
        [(0, 0, "b a b"), (1, 0, "a c"), (2, 1, ""), (3, 2, "z")], "review_id long, cluster int, comment string"
    )
    report = [tuple(r) for r in clusters.cluster_topics(rows, 2).orderBy("cluster").collect()]
    assert report == [(0, "Cluster 1", ["b", "a"]), (1, "Cluster 2", []), (2, "Cluster 3", ["z"])]
    ordered = [r.cluster for r in clusters.order_clusters(clusters.cluster_topics(rows, 2)).collect()]
    assert ordered == [0, 2, 1]
    assert clusters.n_clusters(rows).first().n_clusters == 3


def test_concatenation_in_chunks(spark):
    rows = spark.createDataFrame([(i, 0, f"t{i}") for i in range(25)], "review_id long, cluster int, comment string")
    chunks = clusters.concat_group(rows, rows_per_chunk=10).orderBy("chunk").collect()
    assert len(chunks) == 3
    assert " ".join(c.text for c in chunks) == " ".join(f"t{i}" for i in range(25))


@pytest.mark.parametrize("limit", [2, 100_000])
def test_samples_and_splits_with_null_and_equal_ids(spark, monkeypatch, limit):
    monkeypatch.setattr(sampling, "_SORTED", limit)
    for ids in ([None] * 7 + [1, 2, 3], [5] * 10, [1, 1, 2, 2, 2, 2, 2, 2, 3, None]):
        df = spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "review_id long, n int").repartition(3)
        train, test = sampling.split(df, 0.3)
        assert train.columns == df.columns and test.count() == 3
        assert sorted(r.n for r in train.union(test).collect()) == list(range(10))
        assert sampling.sample_fraction(df, 0.5).count() == 5
        assert df.where(sampling.split_flag(df, 0.3)).count() >= 3
