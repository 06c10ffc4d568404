"""Votes of packed lists, and what is done with the rows of queries before their targets are rows."""

import random
from collections import Counter

import pyarrow as pa
import pytest

from kinweave.functions import postings
from kinweave.operators import blocking, metrics


@pytest.mark.parametrize("strange", [False, True])
def test_pools_of_packed_lists(spark, strange):
    r = random.Random(3)
    ids = ["S2-000001", "S2-999999", "S2-1000000", "S3-99999999", "S3-000000", *(["S2-0000001", "x", "", "S2-100000000", "S2--00001"] if strange else [])]
    usable = sorted({(r.choice(ids), f"k{r.randrange(9)}") for _ in range(50)})
    keys = sorted({(f"q{r.randrange(5)}", f"k{r.randrange(12)}") for _ in range(40)})
    counts = Counter((q, t) for q, k in keys for t, other in usable if k == other)
    rows, own = spark.createDataFrame(usable, "entity_id string, key string"), spark.createDataFrame(keys, "entity_id string, key string")
    assert {(x.q, x.t): x.votes for x in blocking.count_votes(own, rows).collect()} == counts
    best = {q: sorted((-n, t) for (p, t), n in counts.items() if p == q)[:3] for q in {q for q, _ in counts}}
    pools = blocking.voted(own, rows, 3)
    assert sorted((x.q, x.t, x.votes) for x in blocking.each_vote(pools).collect()) == sorted((q, t, -n) for q, some in best.items() for n, t in some)
    asked = spark.createDataFrame([(q, [*ids, "none"]) for q in [*best, "nobody"]], "q string, asked array<string>")
    both = blocking.voted(own, rows, 3, asked, "right")
    assert sorted(map(tuple, blocking.among(both, "asked").collect())) == sorted((q, t) for q, some in best.items() for _, t in some)
    found = {x.q: x.ids for x in both.select("q", blocking.sorted_ids().alias("ids")).collect()}
    assert found == {q: sorted(t for _, t in best.get(q, [])) for q in [*best, "nobody"]}


def test_lists_take_a_few_bytes_an_id():
    lists = [sorted(random.Random(i).sample(range(2 * postings.BASE, 2 * postings.BASE + 1_000_000), 250)) for i in range(20)]
    bytes_of = postings.packed(pa.array(lists, pa.list_(pa.int32())))
    assert sum(map(len, bytes_of.to_pylist())) < 2.2 * 20 * 250  # as texts they took over 8 bytes an id
    numbers, counts = postings.unpacked(bytes_of)
    assert numbers.tolist() == sum(lists, []) and counts.tolist() == [250] * 20


def test_labels_and_recall_do_not_deal_pairs_by_target(spark):
    pairs = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "q string, t string")
    links = spark.createDataFrame([("a", "y"), ("c", "x")], "source1_entity_id string, target_id string")
    rows = metrics.labels(pairs, links)
    assert sorted(map(tuple, rows.collect())) == [("a", "x", 0), ("a", "y", 1), ("b", "x", 0)]
    assert not [line for line in rows._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning(q" in line and ", t" in line]


def test_records_of_queries_are_not_joined_to_pairs(spark):
    records = spark.createDataFrame([("q1", "a"), ("t1", "b")], "entity_id string, name string")
    own, rows = (spark.createDataFrame([(i, "k")], "entity_id string, key string") for i in ("q1", "t1"))
    pairs = blocking.count_votes(own, rows, 3, blocking.of_side("q", records, ["name"]))
    both = blocking.with_records(pairs, records, records, ["name"])
    assert [tuple(r) for r in both.select("q", "t", "votes", "q_name", "t_name").collect()] == [("q1", "t1", 1, "a", "b")]
    assert [c for c in both.columns if c == "q_name"] == ["q_name"]
