from pyspark.sql import functions as F

from symloom.functions import names as N


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_ids(spark):
    lit = F.lit
    assert value(spark, N.package_id(lit("@acme/core.x-y"), lit("javascript"))) == "pkg_js_acme_core_x_y"
    assert value(spark, N.package_name_from_id(lit("pkg_js_acme_text_splitters"), ("acme",))) == "@acme/text-splitters"
    assert value(spark, N.package_name_from_id(lit("pkg_js_other_thing"), ("acme",))) == "other-thing"
    assert value(spark, N.package_name_from_id(lit("pkg_py_acme_core"))) == "acme-core"
    assert value(spark, N.symbol_id(lit("python"), lit("class"), lit("a.b.C"), lit("p"))).startswith("sym_py_class_a_b_C_")
    assert value(spark, N.symbol_id(lit("go"), lit("class"), lit("a.b.C"), lit("pkg_go_x"))) == "pkg_go_x:a_b_C"
    assert len(value(spark, N.build_id(lit("r"), lit("s"), lit("p")))) == 16


def test_paths(spark):
    cases = {
        "/tmp/x/extracted/libs/core/src/a/b.py": "src/a/b.py",
        "../../src/x.ts": "src/x.ts",
        "/home/u/src/x.ts": "src/x.ts",
        "lib/x.py": "lib/x.py",
        "/abs/x.py": "x.py",
        "": "",
    }
    for path, want in cases.items():
        assert value(spark, N.normalize_source_path(F.lit(path))) == want
    assert value(spark, N.clean_source_path(F.lit("/b/extracted/core/core/./x.py"), F.lit(None).cast("string"))) == "core/./x.py"
    assert value(spark, N.source_link(F.lit("a/b"), F.lit("s"), F.lit("x.py"), F.lit(3))) == "https://github.com/a/b/blob/s/x.py#L3"
    assert value(spark, N.source_link(F.lit("a/b"), F.lit("s"), F.lit("node_modules/x"), F.lit(3))) is None


def test_versions(spark):
    for version, latest, want in [("1.2.3", "9", "1.2.3"), ("importlib.metadata.version(x)", "2.0.0", "2.0.0"), (None, None, "unknown"), ("1.0\n", None, "unknown"), ("2.0.0-beta.1", None, "2.0.0-beta.1"), ("VERSION", None, "unknown")]:
        assert value(spark, N.effective_version(F.lit(version).cast("string"), F.lit(latest).cast("string"))) == want
    overrides = F.create_map(F.lit("0.x"), F.lit("old"), F.lit("1.2.0"), F.lit("exact"))
    assert [value(spark, N.path_for_version(F.lit("now"), overrides, F.lit(v))) for v in ("0.3.1", "1.2.0", "1.2.1")] == ["old", "exact", "now"]


def test_urls(spark):
    assert value(spark, N.symbol_url(F.lit("python"), F.lit("acme_core"), F.lit("acme_core.msgs.Item"))) == "/python/acme-core/msgs/Item"
    assert value(spark, N.symbol_url(F.lit("typescript"), F.lit("@acme/core"), F.lit("Item<T>"))) == "/javascript/acme-core/ItemT"
    parsed = value(spark, N.parse_symbol_url(F.lit("/python/acme-core/msgs/Item")))
    assert parsed.asDict() == {"language": "python", "package_slug": "acme-core", "symbol_path": "msgs/Item", "symbol_name": "Item", "parent_path": "msgs"}
    assert value(spark, N.parse_symbol_url(F.lit("")))["language"] == "javascript"
    assert value(spark, N.unslug_package(F.lit("acme-core"), F.lit("javascript"), ("acme",))) == "@acme/core"
    assert value(spark, N.doc_url(F.lit("src/oss/acme/index.mdx"), F.lit("javascript"), ("acme",))) == "/oss/javascript/acme"


def test_name_matching(spark):
    score = lambda a, b: value(spark, N.match_score(F.lit(a), F.lit(b)))
    assert score("embedAll", "embedAll") == 1.0
    assert score("embedAll", "embed_all") == 0.95
    assert abs(score("embed", "embed_all") - (0.5 + 0.2 * 5 / 8)) < 1e-9
    assert score("alpha", "beta") == 0.0
    assert score("", "abc") == 0.5
    assert value(spark, N.snake_to_camel(F.lit("a_bCd_9x__e"))) == "aBCd_9x_E"
    assert value(spark, N.camel_to_snake(F.lit("fromDocsHTML"))) == "from_docs_html".replace("docs_html", "docs_html")
    assert value(spark, N.word_parts(F.lit("fromDocs_now"))) == ["from", "docs", "now"]


def test_text(spark):
    assert value(spark, N.slug_heading(F.lit("What's  new? é -- A/B"))) == "whats-new-ab"
    assert value(spark, N.first_sentence(F.lit("Does this. And that.\nMore"))) == "Does this."
    assert value(spark, N.first_sentence(F.lit("<p>Does this! Now"), "java")) == "Does this!"
    assert len(value(spark, N.first_sentence(F.lit("word " * 60), "listing"))) == 150
    assert value(spark, N.type_from_signature(F.lit("f(a: int): str"), F.lit("function"))) == "str"
    assert value(spark, N.type_from_signature(F.lit("f()"), F.lit("function"))) is None
