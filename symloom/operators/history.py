"""Snapshot diffs over all releases in one shuffle, and what is told from the resulting history.

Symbols: (package_id, version, ord, qualified_name, kind, signature, returns_type, deprecated, extends, implements,
members, params), and where there are such columns deprecation (struct of message and replacement), type_params,
source_path and source_line. Releases: (package_id, version, major, minor, patch), and where known sha and release_date.
Two rule sets exist: ``build`` and ``detailed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symloom.functions import names as N
from symloom.functions.versions import version_key
from symloom.operators.substrings import holding
from symloom.plans.lineage import cut

CHANGE = "struct<type:string,description:string,breaking:boolean,member_name:string,before:string,after:string>"
VISIBILITY = ("public", "protected", "private")


def change(kind: str, description: Column | str, breaking: Column | bool, member: Column | None = None, before: Column | None = None, after: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    text = F.lit(description) if isinstance(description, str) else description
    fail = F.lit(breaking) if isinstance(breaking, bool) else breaking
    return F.struct(F.lit(kind), text, F.coalesce(fail, F.lit(False)), *[none if x is None else x.cast("string") for x in (member, before, after)]).cast(CHANGE)


def _differ(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def _named(items: Column, name: Column) -> Column:
    """The last item of that name, null if there is none."""
    return F.element_at(F.filter(items, lambda x: x["name"] == name), -1)


def _has(items: Column, name: Column) -> Column:
    return F.exists(items, lambda x: x["name"] == name)


def symbol_changes(a: Column, b: Column, mode: str = "build") -> Column:
    """Signature, return type and bases of symbol ``b`` against ``a``."""
    if mode == "build":
        old, new = F.sort_array(a["extends"]), F.sort_array(b["extends"])
        returns = change("return-type-changed", F.concat(F.lit("Return type changed from "), F.coalesce(a["returns_type"], F.lit("void")), F.lit(" to "), F.coalesce(b["returns_type"], F.lit("void"))), True, None, a["returns_type"], b["returns_type"])
        implements: list[Column] = []
    else:
        old, new = a["extends"], b["extends"]
        returns = change("return-type-changed", "Return type changed", a["returns_type"].isNotNull() & b["returns_type"].isNotNull(), None, a["returns_type"], b["returns_type"])
        implements = [F.when(_differ(a["implements"], b["implements"]), change("implements-changed", "Interfaces changed", True, None, F.array_join(a["implements"], ","), F.array_join(b["implements"], ",")))]
    return F.array_compact(
        F.array(
            F.when(_differ(a["signature"], b["signature"]), change("signature-changed", "Signature changed", False, None, a["signature"], b["signature"])),
            F.when(_differ(a["returns_type"], b["returns_type"]), returns),
            F.when(_differ(old, new), change("extends-changed", "Inheritance changed", True, None, F.array_join(old, ","), F.array_join(new, ","))),
            *implements,
        )
    )


def member_changes(a: Column, b: Column, mode: str = "build") -> Column:
    """Members by name. build: public ones, kind and visibility; detailed: all, breaking if made more restricted."""
    said = lambda verb, m: F.concat(F.lit("Member '"), m["name"], F.lit(f"' {verb}"))
    seen = (lambda m: F.coalesce(m["visibility"] == "public", F.lit(False))) if mode == "build" else (lambda m: F.lit(True))
    removed = F.transform(F.filter(a, lambda m: seen(m) & ~_has(b, m["name"])), lambda m: change("member-removed", said("was removed", m), True, m["name"]))
    added = F.transform(F.filter(b, lambda m: seen(m) & ~_has(a, m["name"])), lambda m: change("member-added", said("was added", m), False, m["name"]))
    both = F.filter(b, lambda m: seen(m) & _has(a, m["name"]))
    order = lambda v: F.array_position(F.array(*map(F.lit, VISIBILITY)), v)
    worse = lambda m: (m["visibility"] != "public") if mode == "build" else order(m["visibility"]) > order(_named(a, m["name"])["visibility"])
    shown = F.transform(
        F.filter(both, lambda m: _differ(_named(a, m["name"])["visibility"], m["visibility"])),
        lambda m: change("member-visibility-changed", said("visibility changed", m), worse(m), m["name"], _named(a, m["name"])["visibility"], m["visibility"]),
    )
    kinds = F.transform(
        F.filter(both, lambda m: _differ(_named(a, m["name"])["kind"], m["kind"])),
        lambda m: change("member-type-changed", said("kind changed", m), True, m["name"], _named(a, m["name"])["kind"], m["kind"]),
    )
    return F.concat(removed, added, kinds, shown) if mode == "build" else F.concat(added, removed, shown)


def member_snapshot_changes(a: Column, b: Column) -> Column:
    """Resolved members (name, signature, optional, visibility, readonly, static) against each other."""
    both = F.filter(b, lambda m: _has(a, m["name"]))

    def told(kind: str, field: str, breaking) -> Column:
        old = lambda m: _named(a, m["name"])[field]
        return F.transform(F.filter(both, lambda m: _differ(old(m), m[field])), lambda m: change(kind, F.concat(F.lit(f"{field} of "), m["name"], F.lit(" changed")), breaking(old(m), m[field]), m["name"], old(m), m[field]))

    order = lambda v: F.array_position(F.array(*map(F.lit, VISIBILITY)), v)
    return F.concat(
        F.transform(F.filter(b, lambda m: ~_has(a, m["name"])), lambda m: change("member-added", F.concat(F.lit("Added member "), m["name"]), False, m["name"])),
        F.transform(F.filter(a, lambda m: ~_has(b, m["name"])), lambda m: change("member-removed", F.concat(F.lit("Removed member "), m["name"]), True, m["name"])),
        told("member-type-changed", "signature", lambda old, new: ~F.contains(new, F.regexp_replace(old, "[?:]", ""))),
        told("member-optionality-changed", "optional", lambda old, new: old & ~new),
        told("member-visibility-changed", "visibility", lambda old, new: order(new) > order(old)),
        told("member-readonly-changed", "readonly", lambda old, new: ~old & new),
        told("member-static-changed", "static", lambda old, new: F.lit(True)),
    )


def param_changes(a: Column, b: Column, mode: str = "build") -> Column:
    """build: a count, or positional types if counts agree; detailed: by name, with widening, optionality and default."""
    if mode == "build":
        more = F.size(b) - F.size(a)
        counted = F.array_compact(
            F.array(
                F.when(more > 0, change("param-added", F.concat(more.cast("string"), F.lit(" parameter(s) added")), False)),
                F.when(more < 0, change("param-removed", F.concat((-more).cast("string"), F.lit(" parameter(s) removed")), True)),
            )
        )
        typed = F.zip_with(a, b, lambda x, y: F.when(_differ(x["type"], y["type"]), change("param-type-changed", F.concat(F.lit("Parameter '"), x["name"], F.lit("' type changed")), True, x["name"], x["type"], y["type"])))
        return F.when(more != 0, counted).otherwise(F.array_compact(typed))
    both = F.filter(b, lambda p: _has(a, p["name"]))
    old = lambda p: _named(a, p["name"])
    wider = lambda p: F.contains(p["type"], F.lit("|")) & F.contains(p["type"], old(p)["type"])
    return F.concat(
        F.transform(F.filter(b, lambda p: ~_has(a, p["name"])), lambda p: change("param-added", F.concat(F.lit("Added parameter "), p["name"]), p["required"], p["name"], None, p["type"])),
        F.transform(F.filter(a, lambda p: ~_has(b, p["name"])), lambda p: change("param-removed", F.concat(F.lit("Removed parameter "), p["name"]), True, p["name"], p["type"])),
        F.transform(F.filter(both, lambda p: _differ(old(p)["type"], p["type"])), lambda p: change("param-type-changed", F.concat(F.lit("Type of parameter "), p["name"], F.lit(" changed")), ~wider(p), p["name"], old(p)["type"], p["type"])),
        F.transform(F.filter(both, lambda p: _differ(old(p)["required"], p["required"])), lambda p: change("param-optionality-changed", F.concat(F.lit("Parameter "), p["name"], F.lit(" optionality changed")), p["required"], p["name"], old(p)["required"], p["required"])),
        F.transform(F.filter(both, lambda p: _differ(old(p)["default"], p["default"])), lambda p: change("param-default-changed", F.concat(F.lit("Default value of "), p["name"], F.lit(" changed")), False, p["name"], old(p)["default"], p["default"])),
    )


def all_changes(a: Column, b: Column, mode: str) -> Column:
    return F.concat(symbol_changes(a, b, mode), member_changes(a["members"], b["members"], mode), param_changes(a["params"], b["params"], mode))


def snapshots_equal(a: Column, b: Column) -> Column:
    """Whether signature, members, params and bases agree, by position."""
    return a["signature"].eqNullSafe(b["signature"]) & a["members"].eqNullSafe(b["members"]) & a["params"].eqNullSafe(b["params"]) & a["extends"].eqNullSafe(b["extends"]) & a["implements"].eqNullSafe(b["implements"])


SNAPSHOT = ("kind", "signature", "returns_type", "deprecated", "extends", "implements", "members", "params")


def _snapshot() -> Column:
    """Compared columns; missing lists count as empty ones."""
    return F.struct(*[F.coalesce(F.col(c), F.slice(F.col(c), 1, 0)).alias(c) if c in ("members", "params") else F.col(c) for c in SNAPSHOT])


#: What a snapshot in the history holds besides, where the symbol table has it.
CARRIED = ("type_params", "source_path", "source_line")


def _as_told(snap: Column, carried: list[str]) -> Column:
    """The snapshot of a delta: public members only."""
    public = F.filter(snap["members"], lambda m: m["visibility"] == "public")
    return F.struct(*[(public if c == "members" else snap[c]).alias(c) for c in (*SNAPSHOT, *carried)])


def last_of_name(symbols: DataFrame) -> DataFrame:
    """One row for each (package, version, name): the last in file order."""
    window = Window.partitionBy("package_id", "version", "qualified_name").orderBy(F.desc("ord"))
    return symbols.withColumn("_n", F.row_number().over(window)).filter("_n = 1").drop("_n")


def version_ranks(symbols: DataFrame, releases: DataFrame) -> DataFrame:
    """(package_id, version, rank, previous_version, next_version) of the releases that have symbols."""
    loaded = releases.join(symbols.select("package_id", "version").distinct(), ["package_id", "version"], "left_semi")
    window = Window.partitionBy("package_id").orderBy(version_key("version"))
    return loaded.select("package_id", "version", (F.row_number().over(window) - 1).alias("rank"), F.lag("version").over(window).alias("previous_version"), F.lead("version").over(window).alias("next_version"))


def release_deltas(symbols: DataFrame, releases: DataFrame, mode: str = "build") -> DataFrame:
    """(package_id, version, previous_version, change, qualified_name, kind, changes, snapshot_before, snapshot_after,
    message, replacement, sha, release_date) for all neighbouring releases.

    The table is dealt once by (package, name), where all versions of a symbol meet; added, removed, modified and
    (detailed) deprecated rows are told from the versions before and after. The first version adds everything.
    Versions without symbols are passed over; of equal names the last in file order counts.

    Added and deprecated rows carry the snapshot after, modified ones both; deprecated ones the message and the
    replacement that the symbol names. sha and release_date are those of the release, null where unknown.
    """
    carried = [c for c in CARRIED if c in symbols.columns]
    deprecation = F.col("deprecation") if "deprecation" in symbols.columns else F.lit(None).cast("struct<message:string,replacement:string>")
    known = F.struct(*[(F.col(c) if c in releases.columns else F.lit(None)).cast("string").alias(c) for c in ("sha", "release_date")])
    dated = releases.select("package_id", "version", known.alias("release"))
    following = dated.select("package_id", F.col("version").alias("next_version"), F.col("release").alias("next_release"))
    ranks = version_ranks(symbols, releases).join(dated, ["package_id", "version"], "left").join(following, ["package_id", "next_version"], "left")
    ranked = symbols.select("package_id", "version", "qualified_name", "ord", F.struct(_snapshot().alias("s"), *carried, deprecation.alias("deprecation")).alias("all")).join(ranks, ["package_id", "version"])
    ranked = ranked.withColumn("snap", F.struct("all.s.*", *[F.col(f"all.{c}") for c in (*carried, "deprecation")])).drop("all")
    dealt = ranked.repartition("package_id", "qualified_name")
    last = Window.partitionBy("package_id", "qualified_name", "rank").orderBy(F.desc("ord"))
    dealt = dealt.withColumn("_n", F.row_number().over(last)).filter("_n = 1")
    line = Window.partitionBy("package_id", "qualified_name").orderBy("rank")
    seen = dealt.withColumns({"before": F.lag("snap").over(line), "before_rank": F.lag("rank").over(line), "after_rank": F.lead("rank").over(line)})
    snap, before = F.col("snap"), F.col("before")
    kept = F.coalesce(F.col("before_rank") == F.col("rank") - 1, F.lit(False))
    gone = F.col("next_version").isNotNull() & ~F.coalesce(F.col("after_rank") == F.col("rank") + 1, F.lit(False))
    none = F.array().cast(f"array<{CHANGE}>")
    found = F.when(kept, all_changes(before, snap, mode)).otherwise(none)
    kinds = [F.when(~kept, "added"), F.when(kept & (F.size("found") > 0), "modified"), F.when(gone, "removed")]
    if mode == "detailed":
        newly = F.coalesce(snap["deprecated"], F.lit(False)) & ~(kept & F.coalesce(before["deprecated"], F.lit(False)))
        kinds.append(F.when(newly & F.col("previous_version").isNotNull(), "deprecated"))
    # the kind alone is exploded, so that nobody who does not ask for snapshots makes them
    told = seen.withColumn("found", found).withColumn("change", F.explode(F.array_compact(F.array(*kinds))))
    of = lambda *kinds: F.col("change").isin(*kinds)
    later, release = F.when(of("removed"), F.col("next_version")).otherwise(F.col("version")), F.when(of("removed"), F.col("next_release")).otherwise(F.col("release"))
    details = {
        "changes": F.when(of("modified"), F.col("found")).otherwise(none),
        "snapshot_before": F.when(of("modified"), _as_told(before, carried)),
        "snapshot_after": F.when(~of("removed"), _as_told(snap, carried)),
        "message": F.when(of("deprecated"), snap["deprecation"]["message"]),
        "replacement": F.when(of("deprecated"), snap["deprecation"]["replacement"]),
        "sha": release["sha"],
        "release_date": release["release_date"],
    }
    earlier = F.when(of("removed"), F.col("version")).otherwise(F.col("previous_version"))
    return told.select("package_id", later.alias("version"), earlier.alias("previous_version"), "change", "qualified_name", F.col("snap.kind").alias("kind"), *[c.alias(n) for n, c in details.items()])


def added_symbols(history: DataFrame) -> DataFrame:
    return history.filter("change = 'added'")


def removed_symbols(history: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """Removed rows; with the symbol table, replacement is the first similar name of the newer version."""
    gone = history.filter("change = 'removed'")
    if symbols is None:
        return gone
    keys = ["package_id", "version", "qualified_name"]
    gone = cut(gone)  # told once, for the names asked for and for the rows
    return gone.drop("replacement").join(replacement_candidates(gone.select(*keys), symbols), keys, "left").select(*history.columns)


def modified_symbols(history: DataFrame) -> DataFrame:
    return history.filter("change = 'modified'")


def newly_deprecated(history: DataFrame) -> DataFrame:
    return history.filter("change = 'deprecated'")


def initial_delta(history: DataFrame) -> DataFrame:
    return history.filter(F.col("previous_version").isNull())


def diff(older: DataFrame, newer: DataFrame, mode: str = "build") -> DataFrame:
    """Two snapshots of one package joined by name: (qualified_name, change, changes)."""
    a = last_of_name(older).select("qualified_name", _snapshot().alias("a"))
    b = last_of_name(newer).select("qualified_name", _snapshot().alias("b"))
    both = a.join(b, "qualified_name", "full_outer")
    changes = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), all_changes(F.col("a"), F.col("b"), mode))
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.size("changes") > 0, "modified")
    return both.withColumn("changes", changes).select("qualified_name", kind.alias("change"), "changes").filter(F.col("change").isNotNull())


def replacement_candidates(removed: DataFrame, symbols: DataFrame) -> DataFrame:
    """For each removed name the first symbol of the newer version whose base name holds it, or is held by it.

    Different base names only are compared, in both directions (``holding``); each stands for its first symbol, and a
    running least row is all that is kept.
    """
    base = lambda c: F.lower(F.element_at(F.split(c, r"\."), -1))
    at = ["package_id", "version"]
    wanted = cut(removed.select(*at, "qualified_name", base(F.col("qualified_name")).alias("base")))
    newer = symbols.groupBy(*at, base(F.col("qualified_name")).alias("other")).agg(F.min_by(F.struct(F.col("ord"), F.col("qualified_name").alias("candidate")), F.struct("ord", "qualified_name")).alias("first"))
    newer = cut(newer.join(wanted.select(*at).distinct(), at, "left_semi"))
    named = lambda df, c, name: df.select(*at, F.col(c).alias(name))
    holds = holding(named(wanted, "base", "held"), named(newer, "other", "holder"), at).select(*at, F.col("held").alias("base"), F.col("holder").alias("other"))
    held = holding(named(newer, "other", "held"), named(wanted, "base", "holder"), at).select(*at, F.col("holder").alias("base"), F.col("held").alias("other"))
    best = holds.unionByName(held).join(newer, [*at, "other"]).groupBy(*at, "base").agg(F.min("first").alias("first"))
    return wanted.join(best, [*at, "base"]).select(*at, "qualified_name", F.col("first.candidate").alias("replacement"))


def version_stats(history: DataFrame, symbols: DataFrame | None = None, mode: str = "build") -> DataFrame:
    """added, removed, modified, breaking and total_symbols of each version."""
    count = lambda kind: F.sum(F.when(F.col("change") == kind, 1).otherwise(0))
    broken = F.size(F.filter("changes", lambda c: c["breaking"]))
    if mode == "build":
        breaking = F.sum(broken) + count("removed")
    else:
        breaking = F.sum(F.when((F.col("change") == "modified") & (broken > 0), 1).otherwise(0))
    stats = history.groupBy("package_id", "version").agg(count("added").alias("added"), count("removed").alias("removed"), count("modified").alias("modified"), breaking.alias("breaking"))
    if mode != "build" or symbols is None:
        return stats.withColumn("total_symbols", F.lit(0).cast("long"))
    totals = symbols.groupBy("package_id", "version").agg(F.count_distinct("qualified_name").alias("total_symbols"))
    return stats.join(totals, ["package_id", "version"], "left")


def stale_versions(told: DataFrame, symbols: DataFrame, releases: DataFrame) -> DataFrame:
    """(package_id, version, previous_version) of the versions not in ``told``, and of those that follow one of them."""
    ranks = version_ranks(symbols, releases).join(told.select("package_id", "version").distinct().withColumn("_told", F.lit(True)), ["package_id", "version"], "left")
    window = Window.partitionBy("package_id").orderBy("rank")
    fresh = F.col("_told").isNull()
    return ranks.withColumn("_after", F.coalesce(F.lag(fresh).over(window), F.lit(False))).filter(fresh | F.col("_after")).select("package_id", "version", "previous_version")


def deltas_of(stale: DataFrame, symbols: DataFrame, releases: DataFrame, mode: str = "build") -> DataFrame:
    """Deltas of the given versions (package_id, version, previous_version), from their symbols and their predecessors'."""
    needed = stale.select("package_id", "version").union(stale.filter("previous_version IS NOT NULL").select("package_id", "previous_version")).distinct()
    deltas = release_deltas(symbols.join(needed, ["package_id", "version"], "left_semi"), releases, mode)
    return deltas.join(stale.select("package_id", "version"), ["package_id", "version"], "left_semi").select(*deltas.columns)


def incremental_history(existing: DataFrame, symbols: DataFrame, releases: DataFrame, mode: str = "build", told: DataFrame | None = None) -> DataFrame:
    """Deltas of the versions not told yet, each against its own predecessor, and of those that follow them.

    ``told`` (package_id, version) lists the versions told, also those without changes; without it they are those
    that ``existing`` has rows of, and versions without changes are compared again, to the same end. A release that
    comes late tells its successor anew: ``merge_history`` with ``stale_versions`` replaces that one's rows.
    """
    return deltas_of(stale_versions(existing if told is None else told, symbols, releases), symbols, releases, mode)


def merge_history(new: DataFrame, existing: DataFrame, versions: DataFrame | None = None) -> DataFrame:
    """All deltas; the rows of ``versions`` (those that ``new`` has, if not given) are the new ones only."""
    replaced = (new if versions is None else versions).select("package_id", "version").distinct()
    rest = existing.join(replaced, ["package_id", "version"], "left_anti")
    return new.unionByName(rest.select(*new.columns))


def introduced_in(symbols: DataFrame, releases: DataFrame) -> DataFrame:
    ranks = version_ranks(symbols, releases)
    return symbols.join(ranks, ["package_id", "version"]).groupBy("package_id", "qualified_name").agg(F.min_by("version", "rank").alias("since"))


def modified_in(history: DataFrame) -> DataFrame:
    """Versions with a modification, old to new."""
    changed = history.filter("change = 'modified'").groupBy("package_id", "qualified_name").agg(F.collect_set(F.struct(version_key("version").alias("n"), "version")).alias("v"))
    return changed.select("package_id", "qualified_name", F.transform(F.array_sort("v"), lambda x: x["version"]).alias("versions"))


def deprecated_since(history: DataFrame) -> DataFrame:
    """The earliest deprecation of each symbol: since, message, replacement."""
    first = F.min_by(F.struct("version", "message", "replacement"), version_key("version")).alias("first")
    return history.filter("change = 'deprecated'").groupBy("package_id", "qualified_name").agg(first).select("package_id", "qualified_name", F.col("first.version").alias("since"), "first.message", "first.replacement")


def annotate_latest(latest: DataFrame, symbols: DataFrame, releases: DataFrame, history: DataFrame) -> DataFrame:
    """Symbols of the latest version with since (the oldest version if unknown), modified_in and deprecated (since,
    message, replacement). The history is grouped once."""
    keys = ["package_id", "qualified_name"]
    oldest = releases.groupBy("package_id").agg(F.min_by("version", version_key("version")).alias("oldest"))
    out = latest.drop("deprecated").join(introduced_in(symbols, releases), keys, "left").join(oldest, "package_id", "left")
    out = out.withColumn("since", F.coalesce("since", "oldest")).drop("oldest")
    when = F.struct(version_key("version").alias("n"), "version")
    modified = F.collect_set(F.when(F.col("change") == "modified", when)).alias("modified_in")  # a version each
    entry = F.when(F.col("change") == "deprecated", F.struct(version_key("version").alias("n"), F.col("version").alias("since"), "message", "replacement"))
    told = history.filter("change IN ('modified', 'deprecated')").groupBy(*keys).agg(modified, F.min_by(entry, entry["n"]).alias("deprecated"))
    listed = F.transform(F.array_sort("modified_in"), lambda x: x["version"])
    told = told.select(*keys, F.when(F.size("modified_in") > 0, listed).alias("modified_in"), F.col("deprecated").dropFields("n").alias("deprecated"))
    return out.join(told, keys, "left")


def symbol_history(history: DataFrame) -> DataFrame:
    """Per symbol the list of (version, type, release_date), new to old, and added, modified, deprecated, removed within a version."""
    order = F.array_position(F.array(*map(F.lit, ("added", "modified", "deprecated", "removed"))), F.col("change"))
    entry = F.struct(version_key("version").alias("n"), (-order).alias("o"), "version", F.col("change").alias("type"), "release_date")
    listed = history.groupBy("package_id", "qualified_name").agg(F.sort_array(F.collect_list(entry), asc=False).alias("e"))
    return listed.select("package_id", "qualified_name", F.transform("e", lambda x: F.struct(*[x[c].alias(c) for c in ("version", "type", "release_date")])).alias("entries"))


def symbol_at_version(history: DataFrame, wanted: DataFrame) -> DataFrame:
    """The snapshot of each wanted (package_id, qualified_name, version), as the history has it: that of the last
    addition or modification up to the version; no row where the symbol is gone by then."""
    keys = ["package_id", "qualified_name"]
    at = version_key("version", ties=False).alias("at")
    told = history.filter("change IN ('added', 'modified', 'removed')").select(*keys, "version", at, F.lit(0).alias("asks"), F.struct("change", F.col("version").alias("told_in"), "snapshot_after").alias("last"))
    asked = wanted.select(*keys, "version").distinct().select(*keys, "version", at, F.lit(1).alias("asks"), F.lit(None).cast(told.schema["last"].dataType).alias("last"))
    # one sort of both; equal versions are told before they are asked for
    line = Window.partitionBy(*keys).orderBy("at", "asks", "version").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = told.unionByName(asked).withColumn("last", F.last("last", ignorenulls=True).over(line)).filter("asks = 1")
    return met.filter("last.change <> 'removed'").select(*keys, "version", "last.told_in", F.col("last.snapshot_after").alias("snapshot"))


def history_totals(stats: DataFrame) -> DataFrame:
    return stats.groupBy("package_id").agg(F.sum("added").alias("added"), F.sum("removed").alias("removed"), F.sum("modified").alias("modified"), F.max_by("version", version_key("version")).alias("latest"))
