"""Line helpers and corpus operators on own examples."""

from pyspark.sql import functions as F

from symloom.functions import lines as L
from symloom.operators import corpus as C
from symloom.operators import search as S
from symloom.operators import xref as X
from symloom.sources import io


def test_fences():
    text = "a\n```python\nx = 1\n\n```\n```\n```\n```ts title\nlet y\n```   \n```open\nnever closed"
    assert L.fences(text) == [("python", 2, "x = 1\n"), ("ts", 8, "let y")]
    assert L.fences("") == []


def test_imports(spark):
    blocks = spark.createDataFrame([("p", 1, "from a.b import (\n  X as Y,\n  Z,\n)\nfrom .rel import W\nfrom c import *\nimport os\nfrom d import (\n  P,  # note\n  Q,\n)")], "path string, start_line int, code string")
    assert [(r["package"], r["symbols"]) for r in C.python_imports(blocks).collect()] == [("a.b", ["X", "Z"]), ("d", ["P"])]  # a note hides the name after it
    code = 'import D, { A as B, type C } from "@x/y";\nimport * as N from "n";\nimport { R } from "./rel";\nimport type { T } from \'t\';'
    got = C.javascript_imports(spark.createDataFrame([("p", 1, code)], "path string, start_line int, code string")).collect()
    assert [(r["package"], r["symbols"], r["default_name"], r["is_type"]) for r in got] == [("@x/y", ["A", "type"], "D", False), ("t", ["T"], None, True)]


def test_sections_and_as_of(spark):
    docs = spark.createDataFrame([("p", "---\ntitle: 'T'\n---\n# One\ntext\n## Two words!\n#no\n```py\nx\n```")], "path string, content string")
    heads = C.sections(docs)
    assert [(r["level"], r["anchor"], r["start_line"]) for r in heads.orderBy("start_line").collect()] == [(1, "one", 1), (2, "two-words", 3)]
    assert [r["start_line"] for r in C.sections(docs, "file").orderBy("start_line").collect()] == [4, 6]
    asked = spark.createDataFrame([("p", 1), ("p", 2), ("p", 9), ("q", 1)], "path string, start_line int")
    assert {(r["path"], r["start_line"]): r["section"] for r in C.containing_section(asked, heads).collect()} == {("p", 1): "one", ("p", 2): "one", ("p", 9): "two-words", ("q", 1): None}
    assert C.page_metadata(docs).first()["title"] == "T"


PAGES = {
    "a": "---\ntitle: x\n---\n# One\n```python\nfrom a.b import (\n  X,\n  Y)\n```\n## Two\n```js\nimport D, { A } from '@x/y/z';\n```\n```py\nfrom a import Z\n",
    "b": "```python\n```\n# Late\r\n```ts\nimport type { T } from \"@x/y\";\nimport { R } from './rel';\n```\n  ```python\nfrom a import indented\n  ```\n```\nfrom a import plain\n```",
    "c": "text\n```python3 title\nfrom ab import no\nfrom a.b.c import W as V\n```\n####### seven\n#none\n###   Three  \n```PY\nfrom a import (P,\n  Q)\n```",
    "d": "---\nx\n---",
    "e": "---\n# inside\n```py\nfrom a import late\n```\n# after",
    "f": "",
}


def test_scan_imports_in_one_pass(spark):
    """Unclosed, indented, empty and untagged fences, clauses over several lines, nested known packages, repeated pages."""
    docs = spark.createDataFrame([*PAGES.items(), ("n", None)], "path string, content string")
    known = spark.createDataFrame([("a", "python"), ("a.b", "python"), ("a", "python"), ("@x/y", "javascript"), ("@x/y/z", "javascript"), (None, "python"), ("ab", "go")], "name string, language string")
    scanned = C.scan_imports(docs, known)
    want = [
        ("a", 5, "X", "a.b", "one", "python"), ("a", 5, "Y", "a.b", "one", "python"), ("a", 11, "A", "@x/y/z", "two", "javascript"), ("a", 11, "D", "@x/y/z", "two", "javascript"),
        ("b", 4, "T", "@x/y", "late", "javascript"), ("c", 2, "W", "a.b.c", None, "python"), ("c", 9, "P", "a", "three", "python"), ("c", 9, "Q", "a", "three", "python"), ("e", 3, "late", "a", "inside", "python"),
    ]
    rows = lambda df: sorted(tuple(r[c] for c in ("path", "start_line", "symbol", "package", "section", "language")) for r in df.collect())
    assert rows(scanned) == sorted(want)
    twice = C.scan_imports(docs.unionByName(docs).withColumn("symbol", F.lit("clash")), known)
    assert rows(twice) == sorted(2 * want)
    of_blocks = {(r["path"], r["start_line"]): r["section"] for r in C.containing_section(C.code_blocks(docs), C.sections(docs)).collect()}
    assert all(of_blocks[path, line] == section for path, line, _, _, section, _ in want)
    plan = scanned._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "ArrowEvalPython" not in plan
    assert C.scan_imports(docs.limit(0), known).count() == 0 and C.scan_imports(docs, known.limit(0)).count() == 0


def test_related_docs_keeps_twenty_and_the_total(spark):
    matches = spark.createDataFrame([("S", "k", f"p{i:02d}", "a", "python", 1) for i in range(25)] * 2, "symbol string, package string, path string, section string, language string, start_line int")
    pages = spark.createDataFrame([(f"p{i:02d}", f"Title {i:02d}") for i in range(25)], "path string, title string")
    got = C.related_docs(matches, pages).orderBy("rank").collect()
    assert len(got) == 20 and got[0]["title"] == "Title 00" and got[0]["total"] == 25
    few = C.related_docs_for(spark.createDataFrame([("S",), ("none",)], "symbol string"), C.related_docs(matches, pages), 3)
    assert {r["symbol"]: (r["paths"], r["total"]) for r in few.collect()} == {"S": (["p00", "p01", "p02"], 25), "none": ([], 0)}


def test_admonitions():
    text = 'x\n!!! note "Read me"\n    one\n\n    ??? warning\n        two\nafter\n!!! tip\n!!! danger-zone inline words'
    assert L.admonition_list(text) == [(2, "note", "Read me", 0, 0, "one\n\n??? warning\n    two"), (5, "warning", "Warning", 0, 1, "two"), (9, "danger-zone", "Danger Zone", 0, 0, "inline words")]


def test_dedent():
    assert L.dedented("  one  ") == "one"
    assert L.dedented("def f():\n    a\n      b\n\n    c") == "def f():\na\n  b\n\nc"
    assert L.dedented("  a\n    b\n") == "a\n  b\n"
    assert L.dedented("a\nb") == "a\nb"


def test_subpages():
    text = "---\nt: 1\n---\n\nIntro --8<-- \"gone.md\"\n\n::: acme.mod extra\n    options:\n      members:\n        - Item\n        - __init__\n        - make_tool\n        - run\n        - dash-name\n::: acme.plain\n::: #skip\n"
    assert L.subpage_parts(text) == ("Intro", ["acme.mod.Item", "acme.mod.make_tool", "acme.mod.dash-name", "acme.plain"])
    assert L.subpage_parts("only text\n") == ("only text", [])


def test_links(spark):
    docs = spark.createDataFrame([("p", "[a](x/y.py) ![i](./i.PNG?x=1) [b](./dir) [m](mailto:x) [h](#a) <img class='c' src=\"z.svg\"/> ![j](doc.txt)")], "path string, content string")
    got = {r["target"]: r["url"] for r in C.page_links(docs, "o/r", "main", "https://raw", "pkg").collect()}
    assert got == {"x/y.py": "https://github.com/o/r/blob/main/pkg/x/y.py", "./i.PNG?x=1": "https://raw/i.PNG?x=1", "./dir": "https://github.com/o/r/tree/main/pkg/dir", "mailto:x": "mailto:x", "#a": "#a", "z.svg": "https://raw/z.svg", "doc.txt": "doc.txt"}


def test_known_packages(spark):
    imports = spark.createDataFrame([("a.b",), ("ab",), ("a",), ("c.d.e",)], "package string")
    known = spark.createDataFrame([("a",), ("c.d",)], "name string")
    assert {r["package"] for r in C.known_package_imports(imports, known).collect()} == {"a.b", "a", "c.d.e"}


def test_ancestors_with_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 5)], "child long, base long")
    got = {(r["child"], r["base"]): r["depth"] for r in X.ancestors(edges).collect()}
    assert got == {(1, 2): 1, (1, 3): 2, (2, 3): 1, (2, 1): 2, (3, 1): 1, (3, 2): 2, (4, 1): 1, (4, 2): 2, (4, 3): 3, (5, 5): 1}


def test_search_ranks_titles_first(spark):
    records = spark.createDataFrame([("1", "loader", ["loader"], "reads files"), ("2", "reader", ["reader"], "a loader of files"), ("3", "other", ["other"], "nothing")], "id string, title string, keywords array<string>, excerpt string")
    index = S.build_search_index(records)
    ask = spark.createDataFrame([("exact", "loader"), ("prefix", "load"), ("slip", "loadr")], "query_id string, query string")
    best = S.top(S.search(ask, index), 5)
    got = {}
    for r in best.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["doc"])
    assert got == {"exact": ["1", "2"], "prefix": ["1", "2"], "slip": ["1", "2"]}


def test_readers(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c/one.json").write_text('{"project": "p", "language": "python", "repo": "r", "packages": [{"name": "a", "index": 2}, {"name": "b"}], "externalPackages": [{"name": "x"}]}')
    (tmp_path / "c/one-versions.json").write_text('{"project": "p", "language": "python", "packages": [{"packageName": "a", "versions": [{"version": "2.0.0", "releaseDate": "2024-01-02T00:00:00Z"}, {"version": "1.0.0"}]}]}')
    assert [(r["position"], r["name"]) for r in io.read_configs(spark, str(tmp_path / "c")).orderBy("position").collect()] == [(0, "a"), (1, "b"), (2, "x")]
    assert [(r["position"], r["version"]) for r in io.read_releases(spark, str(tmp_path / "c")).orderBy("position").collect()] == [(0, "2.0.0"), (1, "1.0.0")]
    (tmp_path / "s").mkdir()
    (tmp_path / "s/bare.json").write_text('[{"id": "1", "name": "A", "members": [{"name": "m", "id": "9"}]}, {"id": "2", "name": "B"}]')
    (tmp_path / "s/wrapped.json").write_text('{"package": {}, "symbols": [{"id": "3", "name": "C", "members": [{"name": "m", "refId": "8", "id": "9"}]}]}')
    got = {r["name"]: (r["ord"], [m["ref_id"] for m in r["members"] or []]) for r in io.read_symbols(spark, str(tmp_path / "s")).collect()}
    assert got == {"A": (0, ["9"]), "B": (1, []), "C": (0, ["8"])}
    for name in ("d/a.md", "d/b.mdx", "d/c.txt", "d/node_modules/x.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("# " + name)
    assert sorted(r["content"] for r in io.read_docs(spark, str(tmp_path / "d")).collect()) == ["# d/a.md", "# d/b.mdx"]


def test_pages_are_read_in_slices_of_bytes():
    """What a reader holds and gives on at once follows a bound in bytes, not the rows of a batch."""
    import pyarrow as pa

    page = "# One\n```python\nfrom a import b\n" + "x = 1\n" * 50_000 + "```\n!!! note\n    inside\n"
    pages = [None, "", *[page] * 20, "no fence", page * 5, "!!! tip\n    end"]
    batch = pa.RecordBatch.from_pydict({"path": [str(i) for i in range(len(pages))], "content": pages})
    whole = [(str(i), *f) for i, p in enumerate(pages) if p for f in L.fences(p)]
    for read, want in ((L.line_blocks, whole), (L.admonition_rows, [(str(i), *a) for i, p in enumerate(pages) if p for a in L.admonition_list(p)])):
        parts = list(read(iter([batch])))
        assert [tuple(r.values()) for x in parts for r in x.to_pylist()] == want
        assert max(len({r["path"] for r in x.to_pylist()}) for x in parts) <= 6
    parts = list(L.headed_blocks(("python",), ())(iter([batch.to_pandas()])))
    assert [r for x in parts for r in x.itertuples(index=False, name=None)] == [(*w[:3], L.joined_parens(w[3]), "One") for w in whole]
    assert max(len(x) for x in parts) <= 6


def test_fenced_examples_read_a_page_once(spark):
    """One walk over the text, with the rows of the expression that finds them."""
    pages = ["a:\n```py\nx\n```\nb", "```\n\n```", "t ```x y\n  z\n ``` ```\n", "one\n   ```ts\n    a\n      b\n   ```\n```q\nopen", "````\n```\n````", "é:\n```py\u00e9\ncode\n```", "no\r\n```a\r\nb\r\n```", "", None, "```", "x\n\t```\n\tp\n\t\tq```r\ns```"]
    docs = spark.createDataFrame([(str(i), p) for i, p in enumerate(pages)], "path string, content string")
    pattern = r"(?:^|\n)([^\n]*)\n?[ \t]*```(\w*)[^\n]*\n([\s\S]*?)\n?[ \t]*```"
    parts = F.arrays_zip(*[F.regexp_extract_all("content", F.lit(pattern), i + 1).alias(n) for i, n in enumerate(("title", "language", "code"))])
    want = {(r["path"], r["pos"]): (r["x"]["title"].strip().removesuffix(":") or None, r["x"]["language"] or "python", L.dedented(r["x"]["code"])) for r in docs.select("path", F.posexplode(parts).alias("pos", "x")).collect()}
    found = C.fenced_examples(docs)
    assert {(r["path"], r["pos"]): (r["title"], r["language"], r["code"]) for r in found.collect()} == want and len(want) == 8
    assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_files_are_written_by_the_tasks(spark, tmp_path):
    """Every row is a file of its own with its text as it is, and nothing lies beside them."""
    rows = [(f"part={i % 3}/a b {i}.md", "é\n" * (i + 1)) for i in range(50)]
    for _ in range(2):  # a second run writes the same files
        io.write_files(spark.createDataFrame(rows, "path string, content string"), (tmp_path / "new").as_uri())
    found = {str(p.relative_to(tmp_path / "new")): p.read_bytes().decode() for p in (tmp_path / "new").rglob("*") if p.is_file()}
    assert found == dict(rows)
    assert {r["content"] for r in io.read_docs(spark, str(tmp_path / "new")).collect()} == {c for _, c in rows}
    io.write_files(spark.createDataFrame([], "path string, content string"), str(tmp_path / "none"))
    assert io.read_docs(spark, str(tmp_path / "none")).count() == 0


def test_pages_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    """The driver is told none of the files; what is read is what Spark's reader reads, under the same paths."""
    monkeypatch.setattr(io, "LISTED", 3, raising=False)
    monkeypatch.setattr(io, "SLICE", 20, raising=False)
    monkeypatch.setattr(io, "TASK", 50_000, raising=False)
    odd = ["b c%20d.mdx", "é ü+#?&=;,'()!~[]{}^`|<>\"\\@$*\x7f\u00a0\u2003x.md", "_h.md", "_k=v.md", ".x.md", "up.MD", "m.md._COPYING_", "t.txt", "sub/.git/y.md", "sub/_p/z.md", "sub/_q=1/z.md", "node_modules/n.md", "sub/node_modules_/ok.md", "d.md/in.md", "1/2/3/4/x.mdx"]
    texts = {n: n.encode() * 3 for n in odd} | {f"many/{i}.md": b"line\r\n" * i for i in range(10)} | {"bad.md": b"\xff\xfe\0a", "bom.md": b"\xef\xbb\xbfB"}  # many/0.md is empty
    root = tmp_path / "pa ges%41"
    for name, text in texts.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(text)
    rows = lambda df: sorted(map(tuple, df.selectExpr("path", "hex(cast(content AS binary))").collect()))
    for names in ("*.{md,mdx}", "[b-d]*", "[^b]*.md", "*.{txt,m{d,x}}"):
        plain = spark.read.text(str(root), wholetext=True, recursiveFileLookup=True, pathGlobFilter=names).selectExpr("_metadata.file_path AS path", "value AS content")
        read = io.read_docs(spark, str(root), names)
        assert rows(read) == rows(plain.filter(~F.col("path").rlike("/(node_modules|\\.git)/"))) != []
        assert not [f for f in read.inputFiles() if "pa%20ges" in f]
    assert rows(io.read_docs(spark, root.as_uri().replace("%20", " ").replace("%25", "%"))) == rows(io.read_docs(spark, str(root)))
    for path in (f"{root}/many/7.md", f"{root}/ma*"):  # no folders: Spark's own lists
        assert "many/7.md" in {p[0].partition("%2541/")[2] for p in rows(io.read_docs(spark, path))}
