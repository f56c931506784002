"""Corpus queries over whole texts and all pages, against brute force on a small fixture."""

import hashlib
import pathlib
import re
from collections import Counter

import pytest

import __spark_entry__ as entry
from symloom.functions import lines as L
from symloom.operators import xref as X
from symloom.plans import source_queries
from symloom.plans.bindings import bound

TEXTS = {
    0: "Some words: with `ticks` and a line\n" * 40 + "  deeper line\n\nlast words of zero",
    1: "A " * 9000 + "END",
    2: "x" * 300 + "\n```python\nfrom acme_src2.late import Late\n```\nsee [late](#acme.core.Late)\n# Late heading",
    3: "",
    4: "short",
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    rows = [(i, TEXTS.get(i, f"text {i} " * 50 + f"\nend {i}"), "en", f"src{i % 4}") for i in range(61)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(path + "/documents.parquet")
    return path, {i: t for i, t, *_ in rows}


def rows(spark, folder, name):
    return entry.queries()[name](spark, folder[0]).collect()


def test_file_queries_see_text_behind_the_prefix(spark, folder):
    blocks = [(r["path"], r["code"]) for r in rows(spark, folder, "code_blocks")]
    assert ("docs/src2/page2.md", "from acme_src2.late import Late") in blocks and len(blocks) == 2 * 61 + 1
    assert [r["title"] for r in rows(spark, folder, "sections") if r["anchor"] == "late-heading"] == ["Late heading"]
    assert [r["target"] for r in rows(spark, folder, "page_links") if r["text"] == "late"] == ["#acme.core.Late"]
    assert [r["symbol"] for r in rows(spark, folder, "scan_imports") if r["package"] == "acme_src2.late"] == ["Late"]
    assert sum(r["target"] == "acme.core.Late" for r in rows(spark, folder, "anchor_links")) == 1


def test_text_queries_keep_the_whole_text(spark, folder):
    texts = folder[1]
    got = lambda name: {r["path"]: r for r in rows(spark, folder, name) if "pos" not in r or r["pos"] == 0}
    pages, examples, fences, codes = (got(n) for n in ("parse_subpages_whole", "clean_example_whole", "fenced_examples_whole", "dedent_whole"))
    notes = {r["path"]: r["content"] for r in rows(spark, folder, "admonitions_whole") if r["level"] == 0}
    assert set(pages) == set(examples) == set(fences) == set(codes) == set(notes) == {str(i) for i in texts}
    for i, text in texts.items():
        assert pages[str(i)]["markdown"] == ("Intro " + text).rstrip()
        inner = text.split("\n```")[0]  # a fence in the text ends the example's
        assert examples[str(i)]["text"] == inner.strip()
        assert fences[str(i)]["code"] == L.dedented(inner)
        inside = [" " * 4 + x if x.strip() else " " * 8 + x for x in text.split("\n")]  # blank lines keep their indent
        assert codes[str(i)]["text"] == "\n".join(["def f():", *inside, "  x"])
        assert notes[str(i)] == (text + "\n??? warning inline text\n    deeper").strip()


def test_whole_headings_and_files(spark, folder):
    for r in rows(spark, folder, "slug_heading_whole"):
        kept = re.sub(r"\s+", "-", re.sub(r"[^a-z0-9_\s-]", "", folder[1][int(r["k"])].lower()))
        assert r["value"] == re.sub("^-|-$", "", re.sub("-+", "-", kept))
    got = {r["content"] for r in rows(spark, folder, "read_docs_whole")}
    contents = {r["content"] for r in bound(spark, folder[0], "doc_files").collect()}
    assert len(contents) == 61 and all(any(t in x for x in contents) for t in folder[1].values())
    assert got == {hashlib.md5((x + "\n").encode()).hexdigest() for x in contents}


def test_no_folder_has_all_pages_of_a_part(spark, folder, monkeypatch):
    """Folders are listed by one task each, so they hold few files, however many pages there are."""
    monkeypatch.setattr(source_queries, "FOLDER", 4, raising=False)
    monkeypatch.setattr(source_queries, "scratch", lambda s: f"{folder[0]}/files")
    got = sorted((r["part"], r["content"]) for r in rows(spark, folder, "read_docs_whole"))
    files = Counter(p.parent for p in pathlib.Path(folder[0], "files").rglob("*.txt"))
    assert sum(files.values()) == len(got) == 61 and max(files.values()) <= 4 < 61 / 8
    pages = bound(spark, folder[0], "doc_files").select("doc_id", "content").collect()
    assert got == sorted((r["doc_id"] % 8, hashlib.md5((r["content"] + "\n").encode()).hexdigest()) for r in pages)


def test_index_pages_count(spark, folder):
    even = [i for i in folder[1] if i % 2 == 0]
    found = [r for r in rows(spark, folder, "scan_imports_all") if r["symbol"] == "Tool"]
    assert len({r["path"] for r in found}) == len(found) == len(even)
    index = {r["path"]: r["section"] for r in found if "index" in r["path"]}
    assert set(index) == {("src/oss/acme/" if i % 3 == 0 else f"docs/src{i % 4}/") + f"{i}/index.md" for i in range(0, 61, 10)}
    assert index["src/oss/acme/30/index.md"] == "using-src2-now" and index["src/oss/acme/0/index.md"] == "more"
    totals = {r["symbol"]: r["total"] for r in rows(spark, folder, "related_docs_all")}
    assert totals["Tool"] == totals["Def"] == len(even)
    assert {r["symbol"]: r["total"] for r in rows(spark, folder, "related_docs_for_all")}["Item10"] == 2  # pages 10 and 60
    assert sum(r["path"] in index for r in rows(spark, folder, "containing_section_all")) == 2 * len(index)


def test_ancestors_of_a_deep_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(103)], "child long, base long")
    got = {(r["child"], r["base"]): r["depth"] for r in X.ancestors(edges).collect()}
    assert got == {(i, j): j - i for i in range(103) for j in range(i + 1, 104)}
