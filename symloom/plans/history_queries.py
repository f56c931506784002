"""Queries for snapshot diffs and histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from symloom.operators import history as H
from symloom.plans.bindings import bound, snapshots, symbols, with_tables
from symloom.plans.lineage import cut
from symloom.plans.registry import query

KEYS = ("package_id", "qualified_name")


def told(changes):
    """Changes as sorted text: type, member and whether breaking."""
    return F.array_join(F.array_sort(F.transform(changes, lambda c: F.concat_ws(":", c["type"], F.coalesce(c["member_name"], F.lit("")), c["breaking"].cast("string")))), ",")


def pairs(spark, sf):
    table = symbols(spark, sf).select(*KEYS, "version", "minor", F.struct(*H.SNAPSHOT).alias("b"))
    before = table.select(*KEYS, (F.col("minor") + 1).alias("minor"), F.col("b").alias("a"))
    return table.join(before, [*KEYS, "minor"])


def deltas(spark, sf, mode="build"):
    return H.release_deltas(*snapshots(spark, sf), mode)


MS = "CASE WHEN {0}m1_name = {0}m2_name THEN [{{'name': {0}m1_name, 'kind': {0}m1_kind, 'vis': {0}m1_vis}}] ELSE [{{'name': {0}m1_name, 'kind': {0}m1_kind, 'vis': {0}m1_vis}}, {{'name': {0}m2_name, 'kind': {0}m2_kind, 'vis': {0}m2_vis}}] END"
PS = "[{{'name': 'first', 'type': {0}p1_type, 'req': {0}p1_required}}, {{'name': 'second', 'type': {0}p2_type, 'req': false}}][1:{0}n_params]"
PAIR = with_tables("flat") + f""",
pair AS (SELECT c.*, p.signature AS o_sig, p.returns_type AS o_ret, p.extends_name AS o_ext, p.deprecated AS o_dep, p.ord AS o_ord, {MS.format('p.')} AS a_ms, {MS.format('c.')} AS b_ms, {PS.format('p.')} AS a_ps, {PS.format('c.')} AS b_ps
  FROM flat c LEFT JOIN flat p ON c.package_id = p.package_id AND c.qualified_name = p.qualified_name AND p.minor = c.minor - 1)"""
SYM = """list_filter([CASE WHEN signature <> o_sig THEN 'signature-changed::false' END, CASE WHEN returns_type <> o_ret THEN 'return-type-changed::true' END, CASE WHEN extends_name <> o_ext THEN 'extends-changed::true' END], lambda x: x IS NOT NULL)"""
HAS = lambda xs, x: f"list_contains(list_transform({xs}, lambda z: z.name), {x}.name)"
OLD = lambda xs, x: f"list_filter({xs}, lambda z: z.name = {x}.name)[1]"
OF = lambda xs, cond, out: f"list_transform(list_filter({xs}, lambda m: {cond}), lambda m: {out})"
MEM_BUILD = "list_concat(list_concat(" + OF("a_ms", f"m.vis = 'public' AND NOT {HAS('b_ms', 'm')}", "'member-removed:' || m.name || ':true'") + ", " + OF("b_ms", f"m.vis = 'public' AND NOT {HAS('a_ms', 'm')}", "'member-added:' || m.name || ':false'") + "), list_concat(" + OF("b_ms", f"m.vis = 'public' AND {HAS('a_ms', 'm')} AND {OLD('a_ms', 'm')}.kind <> m.kind", "'member-type-changed:' || m.name || ':true'") + ", " + OF("b_ms", f"m.vis = 'public' AND {HAS('a_ms', 'm')} AND {OLD('a_ms', 'm')}.vis <> m.vis", "'member-visibility-changed:' || m.name || ':false'") + "))"
POS = lambda x: f"list_position(['public', 'protected', 'private'], {x})"
MEM_DETAIL = "list_concat(" + OF("a_ms", f"NOT {HAS('b_ms', 'm')}", "'member-removed:' || m.name || ':true'") + ", list_concat(" + OF("b_ms", f"NOT {HAS('a_ms', 'm')}", "'member-added:' || m.name || ':false'") + ", " + OF("b_ms", f"{HAS('a_ms', 'm')} AND {OLD('a_ms', 'm')}.vis <> m.vis", f"'member-visibility-changed:' || m.name || CASE WHEN {POS('m.vis')} > {POS(OLD('a_ms', 'm') + '.vis')} THEN ':true' ELSE ':false' END") + "))"
PAR_BUILD = """CASE WHEN len(b_ps) > len(a_ps) THEN ['param-added::false'] WHEN len(b_ps) < len(a_ps) THEN ['param-removed::true'] ELSE list_transform(list_filter(list_zip(a_ps, b_ps), lambda z: z[1].type <> z[2].type), lambda z: 'param-type-changed:' || z[1].name || ':true') END"""
PAR_DETAIL = "list_concat(" + OF("b_ps", f"NOT {HAS('a_ps', 'm')}", "'param-added:' || m.name || CASE WHEN m.req THEN ':true' ELSE ':false' END") + ", list_concat(" + OF("a_ps", f"NOT {HAS('b_ps', 'm')}", "'param-removed:' || m.name || ':true'") + ", list_concat(" + OF("b_ps", f"{HAS('a_ps', 'm')} AND {OLD('a_ps', 'm')}.type <> m.type", "'param-type-changed:' || m.name || ':true'") + ", " + OF("b_ps", f"{HAS('a_ps', 'm')} AND {OLD('a_ps', 'm')}.req <> m.req", "'param-optionality-changed:' || m.name || CASE WHEN m.req THEN ':true' ELSE ':false' END") + ")))"
JOINED = lambda xs: f"array_to_string(list_sort({xs}), ',')"
BUILD, DETAIL = f"list_concat({SYM}, list_concat({MEM_BUILD}, {PAR_BUILD}))", f"list_concat({SYM}, list_concat({MEM_DETAIL}, {PAR_DETAIL}))"


def history(changes: str, detailed: bool = False) -> str:
    """Common table expressions ending in ``hist`` (package_id, version, previous_version, change, qualified_name, kind, changes)."""
    version = lambda d: f"'1.' || CAST(minor {d} AS VARCHAR) || '.0'"
    previous = f"CASE WHEN minor > 0 THEN {version('- 1')} END"
    deprecated = f"UNION ALL SELECT package_id, version, {previous}, 'deprecated', qualified_name, kind, [] FROM pair WHERE minor > 0 AND deprecated AND NOT coalesce(o_dep, false)" if detailed else ""
    return f"""{PAIR}, hist AS (
      SELECT package_id, version, {previous} AS previous_version, 'added' AS change, qualified_name, kind, [] AS changes FROM pair WHERE o_ord IS NULL
      UNION ALL SELECT package_id, version, {previous}, 'modified', qualified_name, kind, {changes} FROM pair WHERE o_ord IS NOT NULL AND len({changes}) > 0
      UNION ALL SELECT package_id, {version('+ 1')}, version, 'removed', qualified_name, kind, [] FROM flat f WHERE minor < 6 AND NOT EXISTS (SELECT 1 FROM flat g WHERE g.package_id = f.package_id AND g.qualified_name = f.qualified_name AND g.minor = f.minor + 1)
      {deprecated})"""


B, D = history(BUILD), history(DETAIL, True)
ROW = f"package_id, version, previous_version, change, qualified_name, kind, {JOINED('changes')} AS changes"


def shown(df, *more):
    return df.select("package_id", "version", "previous_version", "change", "qualified_name", "kind", told(F.col("changes")).alias("changes"), *more)


DATED = ROW + ", md5(package_id || version) AS sha, CAST(1995 + CAST(split_part(version, '.', 2) AS INT) AS VARCHAR) || '-12-31' AS release_date"
dated = lambda df: shown(df, "sha", "release_date")
SNAP = "concat_ws('|', {0}.signature, {0}.returns_type, {0}.extends_name, CASE WHEN {0}.m1_vis = 'public' THEN {0}.m1_name END, CASE WHEN {0}.m2_name <> {0}.m1_name AND {0}.m2_vis = 'public' THEN {0}.m2_name END, {0}.source_path, CAST({0}.ord % 100 + 1 AS VARCHAR), CASE WHEN {0}.kind IN ('class', 'interface') THEN {0}.p1_type END)"
ONE = ", ".join("h." + x for x in ("package_id", "version", "previous_version", "change", "qualified_name", "kind")) + f", {JOINED('h.changes')} AS changes"
AT = "f.package_id = h.package_id AND f.qualified_name = h.qualified_name AND f.version = h.version"


def compact(snap):
    """A snapshot's fields as text."""
    x = F.col(snap)
    names = F.transform(x["members"], lambda m: m["name"])
    bounds = F.transform(x["type_params"], lambda t: t["constraint"])
    return F.when(x.isNotNull(), F.concat_ws("|", x["signature"], x["returns_type"], x["extends"], names, x["source_path"], x["source_line"].cast("string"), bounds)).alias(snap)


query("release_deltas", f"{B} SELECT {DATED} FROM hist")(lambda s, d: dated(deltas(s, d)))
query("release_deltas_detailed", f"{D} SELECT {DATED} FROM hist")(lambda s, d: dated(deltas(s, d, "detailed")))
query("added_symbols", f"{B} SELECT {ONE}, {SNAP.format('f')} AS snapshot_after FROM hist h JOIN flat f ON {AT} WHERE change = 'added'")(lambda s, d: shown(H.added_symbols(deltas(s, d)), compact("snapshot_after")))
query("removed_symbols", f"{B} SELECT {ROW} FROM hist WHERE change = 'removed'")(lambda s, d: shown(H.removed_symbols(deltas(s, d))))
query("modified_symbols", f"""{B} SELECT {ONE}, {SNAP.format('f')} AS snapshot_after, {SNAP.format('g')} AS snapshot_before FROM hist h JOIN flat f ON {AT}
  JOIN flat g ON g.package_id = h.package_id AND g.qualified_name = h.qualified_name AND g.version = h.previous_version WHERE change = 'modified'""")(
    lambda s, d: shown(H.modified_symbols(deltas(s, d)), compact("snapshot_after"), compact("snapshot_before"))
)
query("newly_deprecated", f"{D} SELECT {ONE}, {SNAP.format('f')} AS snapshot_after, 'Left in ' || h.version AS message, 'new_' || f.name AS replacement FROM hist h JOIN flat f ON {AT} WHERE change = 'deprecated'")(
    lambda s, d: shown(H.newly_deprecated(deltas(s, d, "detailed")), compact("snapshot_after"), "message", "replacement")
)
query("initial_delta", f"{B} SELECT {ROW} FROM hist WHERE previous_version IS NULL")(lambda s, d: shown(H.initial_delta(deltas(s, d))))


def compared(name, column, sql):
    query(name, f"{PAIR} SELECT package_id, version, qualified_name, {JOINED(sql)} AS changes FROM pair WHERE o_ord IS NOT NULL")(lambda s, d: pairs(s, d).select("package_id", "version", "qualified_name", told(column()).alias("changes")))


a, b = (lambda: F.col("a")), (lambda: F.col("b"))
compared("symbol_changes", lambda: H.symbol_changes(a(), b(), "detailed"), SYM)
compared("symbol_changes_build", lambda: H.symbol_changes(a(), b(), "build"), SYM)
compared("member_changes", lambda: H.member_changes(a()["members"], b()["members"], "detailed"), MEM_DETAIL)
compared("member_changes_build", lambda: H.member_changes(a()["members"], b()["members"], "build"), MEM_BUILD)
compared("param_changes", lambda: H.param_changes(a()["params"], b()["params"], "detailed"), PAR_DETAIL)
compared("param_changes_build", lambda: H.param_changes(a()["params"], b()["params"], "build"), PAR_BUILD)


def resolved(members):
    """Members with a signature made from kind and visibility, as bound for the member snapshot query."""
    signature = lambda m: F.concat(F.when(m["visibility"] == "private", "readonly ").otherwise(""), m["name"], F.when(m["kind"] == "property", "?: ").otherwise(": "), m["kind"])
    return F.transform(members, lambda m: F.struct(m["name"].alias("name"), signature(m).alias("signature"), F.contains(signature(m), F.lit("?:")).alias("optional"), m["visibility"].alias("visibility"), F.startswith(signature(m), F.lit("readonly ")).alias("readonly"), (m["kind"] == "method").alias("static")))


SIG = lambda m: f"(CASE WHEN {m}.vis = 'private' THEN 'readonly ' ELSE '' END || {m}.name || CASE WHEN {m}.kind = 'property' THEN '?: ' ELSE ': ' END || {m}.kind)"
O = OLD("a_ms", "m")
BOTH = HAS("a_ms", "m")
MEM_SNAP = f"""list_concat(list_concat({OF('b_ms', f"NOT {BOTH}", "'member-added:' || m.name || ':false'")}, {OF('a_ms', f"NOT {HAS('b_ms', 'm')}", "'member-removed:' || m.name || ':true'")}), list_concat(
  {OF('b_ms', f"{BOTH} AND {SIG('m')} <> {SIG(O)}", f"'member-type-changed:' || m.name || CASE WHEN contains({SIG('m')}, regexp_replace({SIG(O)}, '[?:]', '', 'g')) THEN ':false' ELSE ':true' END")},
  list_concat({OF('b_ms', f"{BOTH} AND (m.kind = 'property') <> ({O}.kind = 'property')", "'member-optionality-changed:' || m.name || CASE WHEN m.kind = 'property' THEN ':false' ELSE ':true' END")},
  list_concat({OF('b_ms', f"{BOTH} AND m.vis <> {O}.vis", f"'member-visibility-changed:' || m.name || CASE WHEN {POS('m.vis')} > {POS(O + '.vis')} THEN ':true' ELSE ':false' END")},
  list_concat({OF('b_ms', f"{BOTH} AND (m.vis = 'private') <> ({O}.vis = 'private')", "'member-readonly-changed:' || m.name || CASE WHEN m.vis = 'private' THEN ':true' ELSE ':false' END")},
  {OF('b_ms', f"{BOTH} AND (m.kind = 'method') <> ({O}.kind = 'method')", "'member-static-changed:' || m.name || ':true'")})))))"""
compared("member_snapshot_changes", lambda: H.member_snapshot_changes(resolved(a()["members"]), resolved(b()["members"])), MEM_SNAP)
query("snapshots_equal", f"{PAIR} SELECT package_id, version, qualified_name, signature = o_sig AND extends_name = o_ext AND a_ms = b_ms AND a_ps = b_ps AS same FROM pair WHERE o_ord IS NOT NULL")(
    lambda s, d: pairs(s, d).select("package_id", "version", "qualified_name", H.snapshots_equal(a(), b()).alias("same"))
)

STATS = """SELECT package_id, version, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'modified') AS modified, {0} AS breaking, {1} AS total_symbols
  FROM hist LEFT JOIN (SELECT package_id, version, count(DISTINCT qualified_name) AS total FROM flat GROUP BY ALL) USING (package_id, version) GROUP BY package_id, version"""
BROKEN = "len(list_filter(changes, lambda x: ends_with(x, ':true')))"
VSTATS = STATS.format(f"CAST(sum({BROKEN}) + count(*) FILTER (change = 'removed') AS BIGINT)", "max(total)")
def stats(s, d):
    table, releases = snapshots(s, d)
    return H.version_stats(H.release_deltas(table, releases), table)


query("version_stats", f"{B} {VSTATS}")(stats)
query("version_stats_detailed", f"{D} " + STATS.format(f"count(*) FILTER (change = 'modified' AND {BROKEN} > 0)", "0"))(lambda s, d: H.version_stats(deltas(s, d, "detailed"), mode="detailed"))
query("history_totals", f"{B}, st AS ({VSTATS}) SELECT package_id, CAST(sum(added) AS BIGINT) AS added, CAST(sum(removed) AS BIGINT) AS removed, CAST(sum(modified) AS BIGINT) AS modified, max(version) AS latest FROM st GROUP BY package_id")(
    lambda s, d: H.history_totals(stats(s, d))
)


def _newer(s, d):
    """The versions after 1.3.0, onto the history of those up to it."""
    table, releases = snapshots(s, d)
    old = H.release_deltas(table.filter("minor <= 3"), releases)
    return shown(H.incremental_history(old, table, releases, told=releases.filter("minor <= 3")))


def _merged(s, d):
    every = cut(deltas(s, d))
    return shown(H.merge_history(every.filter("version > '1.3.0'"), every.filter("version < '1.6.0'")))


query("incremental_history", f"{B} SELECT {ROW} FROM hist WHERE version > '1.3.0'")(_newer)
query("merge_history", f"{B} SELECT {ROW} FROM hist")(_merged)
query("introduced_in", with_tables("flat") + " SELECT package_id, qualified_name, arg_min(version, minor) AS since FROM flat GROUP BY ALL")(lambda s, d: H.introduced_in(symbols(s, d), bound(s, d, "releases")))
query("modified_in", f"{B} SELECT package_id, qualified_name, string_agg(version, ',' ORDER BY version) AS versions FROM hist WHERE change = 'modified' GROUP BY ALL")(
    lambda s, d: H.modified_in(deltas(s, d)).withColumn("versions", F.array_join("versions", ","))
)
def _annotated(s, d):
    table, releases = snapshots(s, d)
    return H.annotate_latest(table.filter("minor = 6"), table, releases, H.release_deltas(table, releases, "detailed"))


SINCE = "SELECT package_id, qualified_name, min(version) AS since, 'Left in ' || min(version) AS message, 'new_' || split_part(qualified_name, '.', -1) AS replacement FROM hist WHERE change = 'deprecated' GROUP BY ALL"
query("deprecated_since", f"{D} {SINCE}")(lambda s, d: H.deprecated_since(deltas(s, d, "detailed")))
query("annotate_latest", f"""{D} SELECT l.package_id, l.qualified_name, (SELECT arg_min(version, minor) FROM flat f WHERE f.package_id = l.package_id AND f.qualified_name = l.qualified_name) AS since, m.versions AS modified_in, x.since AS deprecated_since, x.message, x.replacement
  FROM flat l LEFT JOIN (SELECT package_id, qualified_name, string_agg(version, ',' ORDER BY version) AS versions FROM hist WHERE change = 'modified' GROUP BY ALL) m USING (package_id, qualified_name)
  LEFT JOIN ({SINCE}) x USING (package_id, qualified_name) WHERE l.minor = 6""")(
    lambda s, d: _annotated(s, d).select(*KEYS, "since", F.array_join("modified_in", ",").alias("modified_in"), F.col("deprecated.since").alias("deprecated_since"), "deprecated.message", "deprecated.replacement")
)
query("symbol_history", f"""{D} SELECT package_id, qualified_name, string_agg(version || ':' || change || ':' || CAST(1995 + CAST(split_part(version, '.', 2) AS INT) AS VARCHAR) || '-12-31', ',' ORDER BY version DESC, list_position(['added', 'modified', 'deprecated', 'removed'], change)) AS entries FROM hist GROUP BY ALL""")(
    lambda s, d: H.symbol_history(deltas(s, d, "detailed")).select(*KEYS, F.array_join(F.transform("entries", lambda x: F.concat_ws(":", x["version"], x["type"], x["release_date"])), ",").alias("entries"))
)
query("symbol_at_version", f"""{B}, asked AS (SELECT DISTINCT package_id, qualified_name, minor, version FROM flat WHERE ord % 3 = minor % 3),
  last AS (SELECT a.package_id, a.qualified_name, a.version, arg_max(h.change, h.version) AS change, max(h.version) AS told_in FROM asked a JOIN hist h ON h.package_id = a.package_id AND h.qualified_name = a.qualified_name AND h.version <= a.version GROUP BY ALL)
  SELECT l.package_id, l.version, l.qualified_name, l.told_in, {SNAP.format('f')} AS snapshot FROM last l JOIN flat f ON f.package_id = l.package_id AND f.qualified_name = l.qualified_name AND f.version = l.told_in WHERE change <> 'removed'""")(
    lambda s, d: H.symbol_at_version(deltas(s, d), symbols(s, d).filter("ord % 3 = minor % 3").select(*KEYS, "version")).select("package_id", "version", "qualified_name", "told_in", compact("snapshot"))
)
query("diff", f"{PAIR} SELECT '1.' || CAST(3 AS VARCHAR) || '.0' AS version, qualified_name, 'modified' AS change, {JOINED(BUILD)} AS changes FROM pair WHERE minor = 3 AND o_ord IS NOT NULL AND len({BUILD}) > 0")(
    lambda s, d: H.diff(symbols(s, d).filter("minor = 2"), symbols(s, d).filter("minor = 3")).filter("change = 'modified'").select(F.lit("1.3.0").alias("version"), "qualified_name", "change", told(F.col("changes")).alias("changes"))
)
BASE = "lower(split_part({0}, '.', -1))"
GONE = f"""{B}, gone AS (SELECT * FROM hist WHERE change = 'removed'), cand AS (SELECT g.package_id, g.version, g.qualified_name, arg_min(f.qualified_name, f.ord) AS replacement FROM gone g JOIN flat f ON g.package_id = f.package_id AND g.version = f.version
  AND (contains({BASE.format('f.qualified_name')}, {BASE.format('g.qualified_name')}) OR contains({BASE.format('g.qualified_name')}, {BASE.format('f.qualified_name')})) GROUP BY ALL)"""


def _gone(s, d):
    table, releases = snapshots(s, d)
    return H.removed_symbols(H.release_deltas(table, releases)), table


query("replacement_candidates", f"{GONE} SELECT * FROM cand")(lambda s, d: H.replacement_candidates(*_gone(s, d)))
query("removed_with_replacement", f"{GONE} SELECT package_id, version, previous_version, change, qualified_name, kind, '' AS changes, replacement FROM gone LEFT JOIN cand USING (package_id, version, qualified_name)")(
    lambda s, d: shown(H.removed_symbols(*_gone(s, d)), "replacement")
)


def _late(s, d):
    """The history of 1.0 and 1.4 onwards, then the releases between them: 1.4 is told anew."""
    table, releases = snapshots(s, d)
    between = "minor BETWEEN 1 AND 3"
    old = H.release_deltas(table.filter(f"NOT ({between})"), releases)
    told_then = releases.filter(f"NOT ({between})")
    new = H.incremental_history(old, table, releases, told=told_then)
    return shown(H.merge_history(new, old, H.stale_versions(told_then, table, releases)))


query("incremental_history_late", f"{B} SELECT {ROW} FROM hist")(_late)
