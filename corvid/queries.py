"""Queries over the test tables, one or more per operator, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.functions import paths
from corvid.operators import closure, dedupe, diff, gate, merge, score, variants
from corvid.plans import scan as plan
from corvid.sources import manifests
from corvid.sources import scan as sources

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function of (table reader) as a query, with its SQL."""

    def add(function):
        key = name or function.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))

        QUERIES[key] = run
        if sql:
            ORACLE[key] = sql
        return function

    return add


# --- paths -----------------------------------------------------------------------------------------------------------

URL_PATH = r"^https?://[^/?#]+(/[^?#]*)"
_DUCK_PATH = f"regexp_extract(url, '{URL_PATH}', 1)"
#: How the numeric segments of a URL are written in each dialect, by the page's key: what stands before the path, the
#: placeholder as written, and the template that it means.
_RAW = {
    "express": [("", "/:id([0-9]+)", "/{id}"), ("", "/:id?", "/{id}"), ("", "/*rest", "/{rest}"), ("", "/*", "/{wildcard}")],
    "hono": [("", "/:id", "/{id}"), ("", "/*", "/{wildcard}")],
    "koa": [("", "/:id/*", "/{id}/{wildcard}"), ("", "/*rest", "/{rest}")],
    "elysia": [("", "/*rest", "/{rest}"), ("", "/:a/:b", "/{a}/{b}")],
    "fastapi": [("", "/{id:int}", "/{id}"), ("", "/{rest:path}", "/{rest}"), ("", "/{plain}", "/{plain}")],
    "flask": [("", "/<int:id>", "/{id}"), ("", "/<id>", "/{id}"), ("", "/<path:rest>", "/{rest}")],
    "django": [("", "/(?P<id>[0-9]+)/?", "/{id}/"), ("", "/<slug:s>", "/{s}"), ("^", "/<n>", "/{n}")],
    "gin": [("", "/:id", "/{id}"), ("", "/*rest", "/{rest}")],
    "echo": [("", "/*id", "/{wildcard}"), ("", "/:id", "/{id}"), ("", "/*", "/{wildcard}")],
    "fiber": [("", "/:id/*", "/{id}/{wildcard}")],
    "chi": [("", "/{id:[0-9]+}", "/{id}"), ("", "/{id}", "/{id}")],
    "gorillamux": [("", "/{id:[a-z]+}", "/{id}"), ("", "/{a}-{b:[0-9]}", "/{a}-{b}")],
    "nethttp": [("", "/{id...}", "/{id}"), ("GET ", "/{id}", "/{id}")],
    "axum": [("", "/:id", "/{id}"), ("", "/*rest", "/{rest}"), ("", "/{id}", "/{id}")],
    "actix": [("", "/{id:\\d+}", "/{id}"), ("", "/{rest:.*}", "/{rest}")],
    "rocket": [("", "/<id:usize>", "/{id}"), ("", "/<id>", "/{id}")],
    "laravel": [("", "/{id?}", "/{id}"), ("", "/{id}", "/{id}")],
    "symfony": [("", "/{id?1}", "/{id}"), ("", "/{id:user}", "/{id}"), ("", "/{id}", "/{id}")],
    "aspnet": [("", "/{id:int?}", "/{id}"), ("", "/{**rest}", "/{rest}"), ("", "/{id}", "/{id}")],
    "nextjs": [("", "/[id]", "/{id}"), ("", "/(group)/[id]", "/{id}"), ("", "/[...rest]", "/{rest}"), ("", "/[[...rest]]", "/{rest}")],
    "slim": [("", "/{id:[0-9]{1,9}}", "/{id}"), ("", "/{id}", "/{id}"), ("", "/{a:x{b}y}-z", "/{a}-z")],
}


def _register_path(dialect: str, cases: list[tuple[str, str, str]]) -> None:
    n = len(cases)
    by_key = lambda k, f: "CASE " + " ".join(f"WHEN page_id % {n} = {i} THEN {f(c[k])}" for i, c in enumerate(cases)) + " END"
    literal = lambda x: "'" + x + "'"
    end = "regexp_replace({}, '/+$', '')" if dialect == "laravel" else "{}"  # the only dialect whose paths lose a slash there
    written = lambda x: f"regexp_replace({_DUCK_PATH}, '/[0-9]+', '{x.replace(chr(92), chr(92) * 2)}', 'g')"

    def run(table) -> DataFrame:
        path = F.regexp_extract("url", URL_PATH, 1)
        quoted = lambda x: F.lit(x.replace("\\", "\\\\").replace("$", "\\$"))
        one = lambda c: F.concat(F.lit(c[0]), F.regexp_replace(path, F.lit("/[0-9]+"), quoted(c[1])))
        raw = F.get(F.array(*map(one, cases)), (F.col("page_id") % n).cast("int"))
        pages = table("pages").select("page_id", raw.alias("raw"))
        return pages.select("page_id", "raw", paths.template_path(F.col("raw"), dialect).alias("path"))

    query(f"SELECT page_id, {by_key(0, literal)} || {by_key(1, written)} AS raw, {end.format(by_key(2, written))} AS path FROM pages", f"path_{dialect}")(run)


for _dialect, _cases in _RAW.items():
    _register_path(_dialect, _cases)

#: The endpoint of a page: host, and path with numbers as {id} between single slashes.
_ENDPOINTS = rf"""
    SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host,
        '/' || array_to_string(list_filter(string_split(regexp_replace({_DUCK_PATH}, '/[0-9]+', '/{{id}}', 'g'), '/'), lambda s: s <> ''), '/') AS path,
        length(html) AS size FROM pages"""


def _endpoints(table) -> DataFrame:
    path = F.regexp_replace(F.regexp_extract("url", URL_PATH, 1), "/[0-9]+", "/{id}")
    return table("pages").select("page_id", F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"), paths.join_stripped(path).alias("path"), F.length("html").alias("size"))


_CAMEL = """'get' || array_to_string(list_transform(list_filter(string_split(regexp_replace(path, '[{}]', '', 'g'), '/'), lambda s: s <> ''),
        lambda s: array_to_string(list_transform(string_split_regex(s, '[^A-Za-z0-9]+'), lambda p: upper(p[1]) || substr(p, 2)), '')
            || right(regexp_extract(s, '[^A-Za-z0-9]+$'), 1)), '')"""


@query(f"""
    WITH e AS ({_ENDPOINTS}), r AS (SELECT *, row_number() OVER (PARTITION BY host, path ORDER BY size DESC, page_id) AS n FROM e)
    SELECT page_id, host, path, CAST(size AS BIGINT) AS size, {_CAMEL} AS operation_id,
        CASE WHEN split_part(path, '/', 2) NOT IN ('') AND split_part(path, '/', 2) NOT LIKE '{{%' THEN split_part(path, '/', 2) ELSE 'default' END AS tag,
        'medium' AS confidence FROM r WHERE n = 1""")
def endpoint_inventory(table) -> DataFrame:
    """The flagship: endpoints of crawled pages, the best page of each, named, tagged and graded."""
    best = dedupe.keep_best(_endpoints(table), ["host", "path"], F.col("size"), F.col("page_id"))
    gaps = gate.gap_array(("response-schema-unknown", F.lit(True)))
    return best.select(
        "page_id", "host", "path", F.col("size").cast("long").alias("size"), paths.operation_id(F.lit("GET"), F.col("path")).alias("operation_id"),
        paths.tag(F.col("path"), F.lit("index.ts")).alias("tag"), gate.graded(F.lit("high"), gaps).alias("confidence"),
    )


@query(f"WITH e AS ({_ENDPOINTS}) SELECT page_id, CAST(u.i AS BIGINT) AS pos, u.p AS name FROM (SELECT page_id, list_zip(range(1, 100)[1:len(x)], x) AS z FROM (SELECT page_id, regexp_extract_all(path, '\\{{([^}}]+)\\}}', 1) AS x FROM e)) q, unnest(z) t(s), LATERAL (SELECT s[1] AS i, s[2] AS p) u")
def template_params(table) -> DataFrame:
    found = _endpoints(table).select("page_id", F.posexplode(paths.parameters(F.col("path"))).alias("pos", "name"))
    return found.select("page_id", (F.col("pos") + 1).cast("long").alias("pos"), "name")


@query(f"""WITH e AS ({_ENDPOINTS}) SELECT page_id, rtrim(host || path, '/') AS joined, CASE WHEN path = '/' THEN '/' || host || '/' ELSE '/' || host || path || '/' END AS trailing,
    CASE WHEN path = '/' THEN host ELSE host || path END AS prefixed, regexp_replace('/' || host || '/' || path, '/+', '/', 'g') AS collapsed FROM e""")
def path_joins(table) -> DataFrame:
    host, path = F.col("host"), F.col("path")
    return _endpoints(table).select(
        "page_id", F.substring(paths.join_stripped(host, path), 2, 10_000).alias("joined"), paths.join_trailing(host, path).alias("trailing"),
        paths.join_prefix(host, path).alias("prefixed"), paths.join_collapsed(F.concat(F.lit("/"), host, F.lit("/")), path).alias("collapsed"),
    )


@query("""SELECT p_partkey, lower(regexp_replace(p_type, '[ -]+', '_', 'g')) AS snake,
    CASE WHEN p_type LIKE '%ies' THEN regexp_replace(p_type, 'ies$', 'y') WHEN p_type LIKE '%ses' THEN regexp_replace(p_type, 'es$', '') ELSE regexp_replace(p_type, 's$', '') END AS one,
    regexp_replace(p_name, '[^A-Za-z0-9._-]', '_', 'g') AS component, sha256(p_name) AS hash FROM part""")
def name_functions(table) -> DataFrame:
    return table("part").select(
        "p_partkey", paths.snake_case(F.col("p_type")).alias("snake"), paths.singular(F.col("p_type")).alias("one"), paths.component_name(F.col("p_name")).alias("component"),
        sources.content_hash(F.col("p_name")).alias("hash"),
    )


# --- choosing rows ---------------------------------------------------------------------------------------------------

_COUNTS = "SELECT l_orderkey, count(*) AS n, count(DISTINCT l_suppkey) AS s, count(DISTINCT l_returnflag) AS g FROM lineitem GROUP BY l_orderkey"


def _candidates(table) -> DataFrame:
    lines = table("lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_suppkey").alias("s"), F.countDistinct("l_returnflag").alias("g"))
    return table("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "o_orderkey", "n", "s", "g", (F.col("o_orderstatus") == "F").alias("body"))


def _best(weights: tuple[int, int, int], name: str) -> None:
    r, p, b = weights
    rank = f"{r} * n + {p} * s + {b} * CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END - g"
    sql = f"""WITH c AS ({_COUNTS}), q AS (SELECT o_custkey, o_orderkey, CAST({rank} AS BIGINT) AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY {rank} DESC, o_orderkey) AS k
        FROM orders JOIN c ON o_orderkey = l_orderkey) SELECT o_custkey, o_orderkey, score FROM q WHERE k = 1"""

    def run(table) -> DataFrame:
        found = _candidates(table).withColumn("score", dedupe.evidence_score(F.col("n"), F.col("s"), F.col("body"), F.col("g"), weights).cast("long"))
        return dedupe.keep_best(found.select("o_custkey", "o_orderkey", "score"), ["o_custkey"], F.col("score"), F.col("o_orderkey"))

    query(sql, name)(run)


_best((2, 1, 2), "keep_best_a")
_best((3, 2, 4), "keep_best_b")


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY o_custkey")
def first_wins(table) -> DataFrame:
    return dedupe.first_wins(table("orders").select("o_custkey", "o_orderkey", "o_orderpriority"), ["o_custkey"], F.col("o_orderkey"))


@query("SELECT count(*) AS duplicates, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n > 1")
def duplicate_routes(table) -> DataFrame:
    return dedupe.duplicates(table("orders"), ["o_custkey"], F.col("o_orderkey")).agg(F.count(F.lit(1)).alias("duplicates"), F.sum("o_orderkey").alias("keys"))


@query("SELECT p_partkey, CASE WHEN n > 1 THEN p_brand || '_' || n ELSE p_brand END AS name FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part)")
def dup_suffix(table) -> DataFrame:
    return dedupe.numbered_names(table("part"), "p_brand", [F.col("p_partkey")], "name").select("p_partkey", "name")


@query("""WITH n AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 4 = 0 THEN 'r_' || (2 + p_partkey % 7) ELSE 'r' END AS name FROM part), a AS (SELECT p_brand, list(name) AS names FROM n GROUP BY p_brand),
    d AS (SELECT *, row_number() OVER (PARTITION BY p_brand, name ORDER BY p_partkey) - 1 AS k FROM n)
    SELECT p_partkey, CASE WHEN k = 0 THEN name ELSE name || '_' || (list_filter(range(2, 100000), lambda x: NOT list_contains(names, name || '_' || x)))[k] END AS name FROM d JOIN a USING (p_brand)""")
def free_suffix(table) -> DataFrame:
    """Names of which some are suffixed by themselves: r, r, r_2 -> r, r_3, r_2."""
    key = F.col("p_partkey")
    name = F.when(key % 4 == 0, F.concat(F.lit("r_"), (2 + key % 7).cast("string"))).otherwise("r")
    return dedupe.unique_names(table("part").select("p_brand", "p_partkey", name.alias("was")), "p_brand", "was", "p_partkey", "name").select("p_partkey", "name")


@query("""SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER w AS n, sum(n_chars) OVER (w ROWS UNBOUNDED PRECEDING) AS s FROM documents WINDOW w AS (PARTITION BY source ORDER BY n_chars, doc_id)) WHERE n <= 8 AND s <= 24000""")
def topk_budget(table) -> DataFrame:
    docs = table("documents").select("doc_id", "source", "n_chars")
    return score.budgeted(docs, ["source"], F.col("n_chars"), [F.col("n_chars"), F.col("doc_id")], 8, 24_000).select("doc_id", "source")


# --- snapshots -------------------------------------------------------------------------------------------------------

_SNAPSHOTS = """a AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 7 <> 0),
    b AS (SELECT doc_id, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 11 <> 0)"""
_DIFF = f"""WITH {_SNAPSHOTS}, d AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed'
    WHEN a.h <> b.h THEN 'changed' END AS kind FROM a FULL JOIN b ON a.doc_id = b.doc_id)"""


def _snapshots(table) -> tuple[DataFrame, DataFrame]:
    docs = table("documents").select("doc_id", "text")
    later = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    a = docs.filter("doc_id % 7 <> 0").select("doc_id", F.sha2("text", 256).alias("h"))
    return a, docs.filter("doc_id % 11 <> 0").select("doc_id", F.sha2(later, 256).alias("h"))


@query(f"{_DIFF} SELECT doc_id, kind FROM d WHERE kind IS NOT NULL")
def snapshot_diff(table) -> DataFrame:
    return diff.snapshot_diff(*_snapshots(table), "doc_id", "h")


@query(f"{_DIFF} SELECT doc_id FROM d WHERE kind IN ('added', 'changed')")
def affected(table) -> DataFrame:
    return diff.affected(diff.snapshot_diff(*_snapshots(table), "doc_id", "h"), "doc_id")


@query(f"WITH {_SNAPSHOTS} SELECT doc_id FROM a WHERE doc_id NOT IN (SELECT doc_id FROM b)")
def removed_keys(table) -> DataFrame:
    return diff.left_over(*_snapshots(table), "doc_id")


@query("SELECT doc_id, sha256(text) AS hash, CAST(octet_length(encode(text)) AS BIGINT) AS bytes FROM documents")
def content_hash(table) -> DataFrame:
    return table("documents").select("doc_id", sources.content_hash(F.col("text")).alias("hash"), F.octet_length("text").cast("long").alias("bytes"))


@query("SELECT CASE WHEN n_chars > 4000 THEN 'source-skipped' ELSE 'indexed' END AS state, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1")
def size_cap_split(table) -> DataFrame:
    large = sources.too_large(F.col("n_chars"), 4000)
    return table("documents").groupBy(F.when(large, "source-skipped").otherwise("indexed").alias("state")).agg(F.count(F.lit(1)).alias("files"), F.sum("n_chars").alias("chars"))


@query("SELECT count(*) AS files, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, count(*) > 10000 OR sum(octet_length(encode(text))) > 67108864 AS over FROM documents")
def budget_report(table) -> DataFrame:
    return sources.budget_use(table("documents").select(F.lit("all").alias("project"), F.octet_length("text").alias("length"))).drop("project")


@query("""SELECT c_custkey AS key, CASE WHEN c_custkey % 5 = 0 THEN CASE WHEN c_custkey % 7 = 0 THEN c_name WHEN c_custkey % 4 = 0 THEN c_name || ' edited' ELSE c_name END WHEN c_custkey % 7 <> 0 AND c_custkey % 4 = 0 THEN c_name || ' edited'
        WHEN c_custkey % 3 = 0 THEN c_name || ' new' ELSE c_name END AS contract,
    CASE WHEN c_custkey % 5 = 0 THEN 'removed' WHEN c_custkey % 7 = 0 THEN 'added' WHEN c_custkey % 4 = 0 THEN 'edited' ELSE 'scanned' END AS origin FROM customer""")
def merge_three_way(table) -> DataFrame:
    base = table("customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("contract"))
    edited = F.when(F.col("key") % 4 == 0, F.concat("contract", F.lit(" edited"))).otherwise(F.col("contract"))
    fresh = F.when(F.col("key") % 3 == 0, F.concat("contract", F.lit(" new"))).otherwise(F.col("contract"))
    user = base.filter("key % 7 <> 0").withColumn("contract", edited)
    return merge.merge_three_way(user, base, base.filter("key % 5 <> 0").withColumn("contract", fresh), ["key"], ["contract"])


# --- graphs ----------------------------------------------------------------------------------------------------------

_EDGES = """edges AS (SELECT 'app' AS parent, 'r' || r_regionkey AS child, '/' || lower(r_name) AS prefix FROM region
    UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, '/' || lower(n_name) FROM nation
    UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, '/s' || s_suppkey FROM supplier
    UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, '/back' FROM nation WHERE n_nationkey % 10 = 0)"""
_REACHED = f"""WITH RECURSIVE {_EDGES}, reached AS (SELECT 'app' AS router, '' AS prefix, ['app'] AS way, 0 AS depth
    UNION ALL SELECT child, reached.prefix || edges.prefix, list_append(way, child), depth + 1 FROM reached JOIN edges ON parent = router WHERE NOT list_contains(way, child))"""


def _mounts(table) -> tuple[DataFrame, DataFrame]:
    s = lambda c: F.col(c).cast("string")
    edge = lambda df, parent, child, prefix: df.select(parent.alias("parent"), child.alias("child"), prefix.alias("prefix"))
    cat = lambda *x: F.concat(*(F.lit(v) if not isinstance(v, Column) else v for v in x))
    nation = table("nation")
    edges = edge(table("region"), F.lit("app"), cat("r", s("r_regionkey")), cat("/", F.lower("r_name")))
    edges = edges.unionByName(edge(nation, cat("r", s("n_regionkey")), cat("n", s("n_nationkey")), cat("/", F.lower("n_name"))))
    edges = edges.unionByName(edge(table("supplier"), cat("n", s("s_nationkey")), cat("s", s("s_suppkey")), cat("/s", s("s_suppkey"))))
    edges = edges.unionByName(edge(nation.filter("n_nationkey % 10 = 0"), cat("n", s("n_nationkey")), cat("r", s("n_regionkey")), F.lit("/back")))
    return nation.limit(1).select(F.lit("app").alias("router"), F.lit("").alias("prefix")), edges


def _closure(table) -> tuple[DataFrame, DataFrame]:
    """The closure of _mounts, whose root is reached once and each router once for an edge: so many ways may be needed."""
    roots, edges = _mounts(table)
    return closure.mount_closure(roots, edges, budget=max(10_000, edges.count() + 1))


@query(f"{_REACHED} SELECT router, prefix, depth FROM reached")
def mount_closure(table) -> DataFrame:
    return _closure(table)[0]


@query(f"{_REACHED} SELECT parent, child, reached.prefix || edges.prefix AS prefix FROM reached JOIN edges ON parent = router WHERE list_contains(way, child)")
def cycle_report(table) -> DataFrame:
    return _closure(table)[1]


@query("SELECT p_partkey AS router FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def orphans(table) -> DataFrame:
    return closure.orphans(table("part").select(F.col("p_partkey").alias("router")), table("lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("router")))


@query(f"""{_REACHED} SELECT s_suppkey, reached.prefix || '/items/' || s_suppkey AS full_path FROM supplier JOIN reached ON router = 'n' || s_nationkey""")
def site_fanout(table) -> DataFrame:
    sites = table("supplier").select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("router"), "s_suppkey", F.concat(F.lit("/items/"), F.col("s_suppkey").cast("string")).alias("path"))
    return closure.route_sites(sites, _closure(table)[0]).select("s_suppkey", "full_path")


@query(f"{_REACHED} SELECT router FROM (SELECT child AS router FROM edges UNION SELECT parent FROM edges) WHERE router NOT IN (SELECT child FROM edges)")
def root_routers(table) -> DataFrame:
    edges = _mounts(table)[1]
    routers = edges.select(F.col("child").alias("router")).union(edges.select("parent")).distinct()
    return closure.root_routers(routers, edges)


@query(f"""WITH e AS ({_ENDPOINTS}), s AS (SELECT DISTINCT '/' || split_part(path, '/', 2) AS scope FROM e) SELECT page_id, scope FROM e JOIN s ON path = scope OR starts_with(path, scope || '/')""")
def scope_prefix_join(table) -> DataFrame:
    pages = _endpoints(table)
    scopes = pages.select(F.concat(F.lit("/"), F.get(F.split("path", "/"), F.lit(1))).alias("scope")).distinct()
    return closure.covering_scopes(pages.select("page_id", "path"), scopes).select("page_id", "scope")


@query("""SELECT r.event_id, count(h.event_id) AS handlers, min(h.event_id) AS first_handler FROM events r JOIN events h ON h.user_id = r.user_id AND h.event_type = 'error' AND h.ts > r.ts WHERE r.event_type = 'signup' GROUP BY r.event_id""")
def range_handler(table) -> DataFrame:
    """Handlers registered after a route, per scope."""
    events = table("events").withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")))
    return closure.later_handlers(events, "user_id", "ts", F.col("event_type") == "signup", F.col("event_type") == "error", "event_id")


# --- gates, sets and reports -----------------------------------------------------------------------------------------


@query("SELECT DISTINCT user_id AS project, 'on ' || event_type AS framework FROM events WHERE event_type IN (SELECT event_type FROM events WHERE value > 99)")
def manifest_gate(table) -> DataFrame:
    """A pack applies where a package that hints at it is declared."""
    events = table("events")
    hints = events.filter("value > 99").select(F.concat(F.lit("on "), "event_type").alias("framework"), F.col("event_type").alias("package")).distinct()
    return manifests.gated_projects(events.select(F.col("user_id").alias("project"), F.col("event_type").alias("package")), hints)


@query("""WITH f AS (SELECT DISTINCT c_custkey % 400 AS project, c_mktsegment AS framework FROM customer)
    SELECT * FROM f WHERE NOT (framework = 'BUILDING' AND project IN (SELECT project FROM f WHERE framework = 'MACHINERY')) AND NOT (framework = 'FURNITURE' AND project IN (SELECT project FROM f WHERE framework IN ('BUILDING', 'HOUSEHOLD')))""")
def cross_claim(table) -> DataFrame:
    """A pack yields to others that claim the same project."""
    found = table("customer").select((F.col("c_custkey") % 400).alias("project"), F.col("c_mktsegment").alias("framework")).distinct()
    return plan.without_yielding(found, {"BUILDING": ("MACHINERY",), "FURNITURE": ("BUILDING", "HOUSEHOLD")})


@query("SELECT c_custkey AS project, 'BUILDING' AS framework FROM customer WHERE c_mktsegment = 'BUILDING'")
def framework_filter(table) -> DataFrame:
    """What the caller asked for: of the found frameworks, those that were named."""
    found = table("customer").select(F.col("c_custkey").alias("project"), F.col("c_mktsegment").alias("framework"))
    return plan.asked(found, ("BUILDING", "no such"))


_GAPS = """list_filter([CASE WHEN l.doc_id IS NULL THEN 'response-unknown' END, CASE WHEN l.toxic = 1 THEN 'auth-unknown' END, CASE WHEN l.quality = 0 THEN 'query-unknown' END,
    CASE WHEN n_chars < 400 THEN 'header-unknown' END], lambda g: g IS NOT NULL)"""
_GRADED = f"""SELECT d.doc_id, {_GAPS} AS gaps, CASE WHEN l.doc_id IS NULL THEN 'low' WHEN l.quality = 0 THEN 'medium' ELSE 'high' END AS confidence FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


def _graded(table) -> DataFrame:
    labels = table("labels").withColumn("seen", F.lit(1))
    both = table("documents").join(labels, "doc_id", "left")
    gaps = gate.gap_array(("response-unknown", F.col("seen").isNull()), ("auth-unknown", F.col("toxic") == 1), ("query-unknown", F.col("quality") == 0), ("header-unknown", F.col("n_chars") < 400))
    return both.select("doc_id", gaps.alias("gaps")).withColumn("confidence", gate.graded(F.lit("high"), F.col("gaps")))


@query(f"SELECT doc_id, array_to_string(gaps, ',') AS gaps, confidence FROM ({_GRADED})")
def gap_gate(table) -> DataFrame:
    return _graded(table).withColumn("gaps", F.array_join("gaps", ","))


@query(f"SELECT confidence, count(*) AS n, min(doc_id) AS first_doc FROM ({_GRADED}) GROUP BY confidence")
def confidence_rank(table) -> DataFrame:
    return _graded(table).groupBy("confidence").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


@query(f"SELECT gap, count(*) AS n FROM (SELECT unnest(gaps) AS gap FROM ({_GRADED})) GROUP BY gap")
def gap_histogram(table) -> DataFrame:
    return score.gap_histogram(_graded(table))


@query(f"""SELECT count(*) AS routes, count(*) FILTER (confidence = 'high') AS high, count(*) FILTER (confidence <> 'high') AS not_high, count(*) FILTER (len(gaps) > 0) AS with_gaps, CAST(sum(len(gaps)) AS BIGINT) AS gaps FROM ({_GRADED})""")
def scan_report(table) -> DataFrame:
    return score.scan_report(_graded(table))


@query("""WITH f AS (SELECT doc_id, CASE WHEN n_chars > 800 THEN 1 ELSE 0 END AS v FROM documents WHERE doc_id % 3 <> 0), w AS (SELECT doc_id, quality AS v FROM labels),
    c AS (SELECT count(f.doc_id) AS found, count(w.doc_id) AS wanted, count(*) FILTER (f.doc_id IS NOT NULL AND w.doc_id IS NOT NULL) AS matched, count(*) FILTER (f.v = w.v) AS equal FROM f FULL JOIN w ON f.doc_id = w.doc_id),
    a AS (SELECT found, wanted, matched, round(matched / wanted, 4) AS recall, round(matched / found, 4) AS precision, round(equal / matched, 4) AS accuracy FROM c)
    SELECT *, least(recall, precision, accuracy) AS overall, least(recall, precision, accuracy) >= 0.95 AS accepted FROM a""")
def scorecard(table) -> DataFrame:
    found = table("documents").filter("doc_id % 3 <> 0").select("doc_id", F.when(F.col("n_chars") > 800, 1).otherwise(0).alias("v"))
    return score.scorecard(found, table("labels").select("doc_id", F.col("quality").alias("v")), ["doc_id"], "v")


@query("SELECT event_type, CASE WHEN count(DISTINCT v) = 1 AND count(v) = count(*) THEN min(v) END AS type FROM (SELECT event_type, CASE WHEN props LIKE '%{\"k\": %' THEN 'object' WHEN props IS NOT NULL THEN 'string' END AS v FROM events) GROUP BY event_type")
def type_agreement(table) -> DataFrame:
    kind = F.when(F.col("props").contains('{"k": '), "object").when(F.col("props").isNotNull(), "string")
    return variants.agreed_types(table("events").select("event_type", kind.alias("type")), ["event_type"], "type")


@query("""SELECT o_orderpriority, CASE WHEN len(a) = 1 THEN '{"const":"' || a[1].s || '"}' ELSE '{"anyOf":[' || array_to_string(list_transform(a, lambda x: '{"const":"' || x.s || '"}'), ',') || ']}' END AS schema
    FROM (SELECT o_orderpriority, list({'k': k, 's': s} ORDER BY k) AS a FROM (SELECT o_orderpriority, o_orderstatus AS s, min(o_orderkey) AS k FROM orders GROUP BY 1, 2) GROUP BY 1)""")
def variant_union(table) -> DataFrame:
    orders = table("orders").select("o_orderpriority", F.concat(F.lit('{"const":"'), "o_orderstatus", F.lit('"}')).alias("schema"), "o_orderkey")
    return variants.union_schemas(orders, ["o_orderpriority"], "schema", "o_orderkey")


# --- sources ---------------------------------------------------------------------------------------------------------

_EXTENSIONS = ("ts", "mjs", "py", "go", "java", "cs", "rs", "php", "md")
_FILES = "SELECT p_partkey, replace(p_name, ' ', '/') || CASE WHEN p_partkey % 5 = 0 THEN '/tests/a' WHEN p_partkey % 7 = 0 THEN '.test' ELSE '/a' END || '.' || (['ts', 'mjs', 'py', 'go', 'java', 'cs', 'rs', 'php', 'md'])[p_partkey % 9 + 1] AS path FROM part"


def _paths(table) -> DataFrame:
    k = F.col("p_partkey")
    middle = F.when(k % 5 == 0, "/tests/a").when(k % 7 == 0, ".test").otherwise("/a")
    ext = F.get(F.array(*map(F.lit, _EXTENSIONS)), (k % 9).cast("int"))
    return table("part").select(k, F.concat(F.replace("p_name", F.lit(" "), F.lit("/")), middle, F.lit("."), ext).alias("path"))


@query(f"""SELECT p_partkey, CASE regexp_extract(path, '\\.([a-z]+)$', 1) WHEN 'ts' THEN 'typescript' WHEN 'mjs' THEN 'javascript' WHEN 'py' THEN 'python' WHEN 'cs' THEN 'csharp' WHEN 'rs' THEN 'rust' WHEN 'md' THEN NULL
    ELSE regexp_extract(path, '\\.([a-z]+)$', 1) END AS language FROM ({_FILES})""")
def language_by_extension(table) -> DataFrame:
    return _paths(table).select("p_partkey", sources.language(F.col("path")).alias("language"))


@query(f"SELECT p_partkey FROM ({_FILES}) WHERE NOT regexp_matches(path, '\\.test\\.[a-z]+$|(^|/)(tests?|__tests__|scripts?|fixtures?|e2e)/|^examples?/|_test\\.go$')")
def test_file_filter(table) -> DataFrame:
    return _paths(table).filter(~F.col("path").rlike(sources.TEST_FILE)).select("p_partkey")


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def decode_marks(table) -> DataFrame:
    """Texts written as UTF-16 in either order, or UTF-8, and decoded by their marks."""
    text, k = F.col("text"), F.col("doc_id") % 3
    little = F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "UTF-16LE"))
    big = F.concat(F.unhex(F.lit("FEFF")), F.encode(text, "UTF-16BE"))
    raw = F.when(k == 0, little).when(k == 1, big).otherwise(F.encode(text, "UTF-8"))
    return table("documents").select("doc_id", F.sha2(sources.decoded(raw), 256).alias("hash"))


@query("SELECT o_orderkey, CASE WHEN regexp_full_match(CAST(100 + o_orderkey % 500 AS VARCHAR), '1..|204|205|304') THEN 0 ELSE 1 END AS bodies FROM orders")
def bodyless_status(table) -> DataFrame:
    status = (100 + F.col("o_orderkey") % 500).cast("string")
    return table("orders").select("o_orderkey", F.when(status.rlike(f"^(?:{gate.BODYLESS.pattern})$"), 0).otherwise(1).alias("bodies"))


@query("""SELECT n_nationkey, '#/components/schemas/' || replace(replace(replace(replace(n_name, '~', '~0'), '/', '~1'), '~1', '/'), '~0', '~') AS ref, 'get' || string_agg(upper(p[1]) || substr(p, 2), '' ORDER BY i) AS dashed
    FROM (SELECT n_nationkey, n_name, unnest(string_split(lower(n_name) || '/x-y', '/')) AS part, generate_subscripts(string_split(lower(n_name) || '/x-y', '/'), 1) AS a FROM nation) s,
    LATERAL (SELECT unnest(string_split(part, '-')) AS p, a * 100 + generate_subscripts(string_split(part, '-'), 1) AS i) WHERE p <> '' GROUP BY n_nationkey, n_name""")
def pointer_and_dashed_names(table) -> DataFrame:
    escaped = F.replace(F.replace("n_name", F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
    name = paths.dashed_operation_id(F.lit("GET"), F.concat(F.lower("n_name"), F.lit("/x-y")))
    return table("nation").select("n_nationkey", F.concat(F.lit("#/components/schemas/"), paths.pointer_unescaped(escaped)).alias("ref"), name.alias("dashed"))
