"""Operators on the symbol table: raw rows to symbols, documentation sections, filters and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.functions import names as N


def normalize_raw_symbols(raw: DataFrame, package: str | Column, repo: str, sha: str) -> DataFrame:
    """Extractor rows (name, kind, path, signature, members, file, line) to symbols; nameless and unknown ones go."""
    ident = F.lit(package) if isinstance(package, str) else package
    usable = raw.filter((F.coalesce(F.col("name"), F.lit("")) != "") & (F.col("kind") != "unknown"))
    return usable.select(
        ident.alias("package_id"),
        N.symbol_id(F.lit("python"), F.col("kind"), F.col("path"), ident).alias("id"),
        "kind",
        "name",
        F.col("path").alias("qualified_name"),
        "signature",
        F.lit("public").alias("visibility"),
        F.when(F.col("kind").isin("class", "module"), F.col("members")).alias("members"),
        F.struct(F.lit(repo).alias("repo"), F.lit(sha).alias("sha"), F.col("file").alias("path"), F.col("line").alias("line")).alias("source"),
    )


def _of(sections: Column, *kinds: str) -> Column:
    return F.filter(sections, lambda s: s["kind"].isin(*kinds))


def assemble_docs(sections: Column, summary: Column) -> Column:
    """Struct of description (texts but the summary, a blank line between), examples (each once) and deprecation."""
    texts = F.filter(F.transform(_of(sections, "text"), lambda s: s["value"]), lambda v: v != summary)
    return F.struct(
        F.array_join(texts, "\n\n").alias("description"),
        F.array_distinct(F.transform(_of(sections, "examples"), lambda s: s["value"])).alias("examples"),
        F.get(F.transform(_of(sections, "deprecated"), lambda s: s["value"]), F.lit(0)).alias("deprecated"),
    )


def params_and_returns(sections: Column) -> Column:
    """Struct of params (type Any if missing, required without a default) and returns (the first item)."""
    items = F.flatten(F.transform(_of(sections, "parameters", "args", "arguments"), lambda s: s["items"]))
    return F.struct(
        F.transform(
            items,
            lambda i: F.struct(i["name"].alias("name"), F.coalesce(i["type"], F.lit("Any")).alias("type"), i["description"].alias("description"), i["default"].alias("default"), i["default"].isNull().alias("required")),
        ).alias("params"),
        F.get(F.flatten(F.transform(_of(sections, "returns"), lambda s: s["items"])), F.lit(0)).alias("returns"),
    )


def filter_included(symbols: DataFrame, include_private: bool = False, include_special: bool = False, exclude_patterns: tuple[str, ...] = ()) -> DataFrame:
    """Names with a leading underscore go unless allowed (dunder names by ``include_special``), and excluded paths."""
    name, path = F.col("name"), F.col("qualified_name")
    dunder = name.startswith("__") & name.endswith("__")
    kept = F.when(dunder, F.lit(include_special)).when(name.startswith("_"), F.lit(include_private)).otherwise(True)
    for pattern in exclude_patterns:
        kept &= ~path.contains(pattern)
    return symbols.filter(kept)


def filter_excluded_files(files: DataFrame, patterns: tuple[str, ...]) -> DataFrame:
    """Files with a path segment that equals or begins with a pattern go; a segment may carry ``.py``."""
    hit = lambda s: F.coalesce(*[F.when(s.startswith(p) | (F.regexp_replace(s, r"\.py$", "") == p), True) for p in patterns], F.lit(False))
    return files.filter(~F.exists(F.split("path", "/"), hit)) if patterns else files


def drop_external(symbols: DataFrame) -> DataFrame:
    return symbols.filter(~F.coalesce(F.col("source_path").contains("node_modules/"), F.lit(False)))


def snapshot(symbols: DataFrame) -> DataFrame:
    """Compact rows: signature, public members, params, return type, type parameters, bases, place and line."""
    return symbols.select(
        "package_id", "version", "qualified_name", "kind", "signature", "returns_type", "extends", "implements",
        F.filter("members", lambda m: m["visibility"] == "public").alias("members"),
        F.transform("params", lambda p: F.struct(p["name"].alias("name"), p["type"].alias("type"), p["required"].alias("required"))).alias("params"),
        "type_params", "source_path", "source_line",
    )


def member_snapshot(members: DataFrame, symbols: DataFrame) -> DataFrame:
    """Members (package_id, owner, pos, name, ref_id, visibility) with the signature of the symbol they refer to.

    The fallback signature is the name. One row for each owner, members in order.
    """
    known = symbols.select("package_id", F.col("id").alias("ref_id"), F.col("signature").alias("found"), "is_static")
    joined = members.join(known, ["package_id", "ref_id"], "left")
    signature = F.coalesce("found", "name")
    entry = F.struct(
        "pos", "name", signature.alias("signature"), signature.contains("?:").alias("optional"), "visibility", signature.startswith("readonly ").alias("readonly"), F.coalesce("is_static", F.lit(False)).alias("static")
    )
    return joined.groupBy("package_id", "owner").agg(F.sort_array(F.collect_list(entry)).alias("members"))  # members of one class
