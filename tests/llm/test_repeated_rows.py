"""Samples and shards where one id, one text or one group fills the table."""

import random
from collections import defaultdict

import pytest

from symloom.llm import langid, quality_fm, secret_scan, shards

EN = "the house on the river and the light of the winter morning "
FR = "la maison sur la rivière et la lumière du matin d'hiver "


@pytest.mark.parametrize("one", [1, 2, 3, 7, 11])
def test_language_of_one_repeated_id(spark, one):
    rows = [(one, FR * 3, "fr")] * 2000
    found = langid.predicted_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).groupBy("held_out", "lang_pred").count().collect()
    assert [(r["lang_pred"], r["count"]) for r in found] == [("und" if found[0]["held_out"] else "fr", 2000)]


def test_a_repeated_row_beside_a_larger_language(spark):
    r = random.Random(1)
    words = EN.split()
    rows = [(3, FR * 3, "fr")] * 2000 + [(i, " ".join(r.choice(words) for _ in range(30)), "en") for i in range(10, 4010)]
    found = langid.predicted_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {(r["lang_pred"], r["count"]) for r in found.groupBy("lang_pred").count().collect()} == {("fr", 2000), ("en", 4000)}


def test_quality_reads_one_row_of_an_id(spark):
    docs = [(1, "good words here " * 5, 80)] * 3000 + [(1, f"other {i}", 7) for i in range(500)] + [(i, "junk" if i % 2 else "good words here " * 4, 5) for i in range(2, 60)]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, 1 - i % 2 if i > 1 else 1) for i in range(1, 60)], "doc_id long, quality int")
    model = quality_fm.fit(df, labels)
    found = {r["doc_id"]: r["score"] for r in quality_fm.score(df.filter("doc_id > 1"), model).collect()}
    assert len(found) == 58 and min(v for k, v in found.items() if k % 2 == 0) > max(v for k, v in found.items() if k % 2)


def test_groups_stay_whole_where_a_shard_has_room(spark):
    """Copies of one text are cut only if they fill more than a shard has room for."""
    r = random.Random(2)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    rows = [text(r.randint(200, 1600)) for _ in range(1400)]
    for copies, size in ((7, 1500), (60, 400), (200, 300), (90, 1000), (3, 9000), (600, 500)):
        rows += [text(size)] * copies
    total = sum(len(t) + 1 for t in rows)
    found = shards.shard(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(5)).collect()
    where, size = defaultdict(set), defaultdict(int)
    for x in found:
        where[rows[x["doc_id"]]].add(x["shard"])
        size[x["shard"]] += x["size"]
    share = total / 16
    assert len(found) == len(rows) and sorted(size) == list(range(16))
    assert all(len(s) == 1 for t, s in where.items() if (len(t) + 1) * rows.count(t) < share)
    assert len(where[rows[-1]]) > 1 and max(size.values()) < 1.06 * share and min(size.values()) > 0.94 * share


def test_redaction_of_long_texts(spark):
    secret = "token = abcdefghijklmnop1234 "
    rows = [(i, "word " * 40_000 + secret + "end", 7) for i in range(30)] + [(99, None, None), (98, "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    small, large = (sorted(map(tuple, secret_scan.redact(df, slice_bytes=n).collect()), key=lambda x: x[0]) for n in (1 << 10, 1 << 30))
    assert [x[0] for x in small] == [x[0] for x in large] and small[0] == large[0]
    assert all("abcdefghijklmnop1234" not in x[1] and x[1].endswith("end") and x[2] == len(x[1]) for x in small if x[0] < 90)
