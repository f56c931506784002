"""Buckets of near copies that are compared with a pivot first."""

import random
from collections import Counter

from symloom.llm import ngram_join
from tests.llm.test_operators import got, plain_links


def near_copies(groups, members, most_edits, seed):
    r = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"w{r.randint(0, 400)}" for _ in range(200)]
        for _ in range(members):
            words = list(base)
            for _ in range(r.randint(0, most_edits)):
                words[r.randrange(len(words))] = f"x{r.randint(0, 10**6)}"
            rows.append((len(rows) * 7 % 1009, " ".join(words)))
    return rows + rows[:3]


def test_close_and_loose_groups_equal_all_pairs(spark):
    """Links, classes and counts of groups around a base, from almost equal to hardly linked, in small blocks."""
    rows = near_copies(2, 60, 2, 1) + [(d + 2000, t) for d, t in near_copies(2, 60, 9, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = Counter(plain_links(rows))
    assert got(ngram_join.similar_documents(df, block=8), "doc_id", "class_id", "n_links") == want
    assert {n for _, _, n in want} - {59, 60, 61}  # the loose groups are not cliques


def test_a_tight_group_is_not_compared_in_pairs_of_blocks(spark):
    """Where all members lie within half the allowed distance, none travels to another block for its greatest unit."""
    rows = [(i, i, [1, 2 + i % 2], 1, 100) for i in range(64)]
    classes = spark.createDataFrame(rows, "rep long, key long, bands array<long>, n_copies long, n_words long")
    units = ngram_join._units(classes, 8)
    measured = units.filter("best = unit").selectExpr("unit", "rep", "key", "n_copies", "3 as near", "0L as to_rep", "0L as to_key")
    assert ngram_join._compared(units, measured, 8).count() == 0
    links = {r["rep"]: r["links"] for r in ngram_join._certain(measured).collect()}
    assert links == {i: 63 for i in range(64)}
