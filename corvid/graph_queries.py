"""Queries of the fixpoints, sweeps, lookups and reviews' context over the test tables, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvid.functions import paths
from corvid.operators import closure, context, diff, fixpoint, names, nodes, score, sweep, variants
from corvid.queries import _ENDPOINTS, _endpoints, query
from corvid.sources import scan as sources

s = lambda x: (F.col(x) if isinstance(x, str) else x).cast("string")

# --- fixpoints -------------------------------------------------------------------------------------------------------

#: Classes in rings: 10 parts, each on top of the one before, and a supplier that closes the ring.
_RINGS = """e AS (SELECT 'p' || p_partkey AS node, CASE WHEN p_partkey % 10 = 0 THEN 's' || (p_partkey // 10) ELSE 'p' || (p_partkey - 1) END AS base FROM part
    UNION ALL SELECT 's' || s_suppkey, 'p' || (s_suppkey * 10 + 9) FROM supplier)"""


def _rings(table) -> DataFrame:
    key = F.col("p_partkey")
    up = F.when(key % 10 == 0, F.concat(F.lit("s"), s(F.floor(key / 10)))).otherwise(F.concat(F.lit("p"), s(key - 1)))
    parts = table("part").select(F.concat(F.lit("p"), s(key)).alias("node"), up.alias("base"))
    return parts.unionByName(table("supplier").select(F.concat(F.lit("s"), s("s_suppkey")).alias("node"), F.concat(F.lit("p"), s(F.col("s_suppkey") * 10 + 9)).alias("base")))


@query(f"""WITH RECURSIVE {_RINGS}, r AS (SELECT 'p' || p_partkey AS node, p_brand AS label FROM part WHERE p_partkey % 10 = 5 UNION SELECT e.node, label FROM r JOIN e ON e.base = r.node) SELECT node, label FROM r""")
def class_labels(table) -> DataFrame:
    """What classes are by their bases: labels go round rings of 11 classes and end there."""
    seeds = table("part").filter("p_partkey % 10 = 5").select(F.concat(F.lit("p"), s("p_partkey")).alias("node"), F.col("p_brand").alias("label"))
    return fixpoint.spread(seeds, _rings(table)).select("node", "label")


_BASES = "e AS (SELECT DISTINCT p_partkey AS node, unnest([p_partkey // 2, p_partkey // 3]) AS base FROM part WHERE p_partkey > 0)"


@query(f"""WITH RECURSIVE {_BASES}, a AS (SELECT p_partkey AS node, p_partkey AS anc, 0 AS d FROM part UNION SELECT a.node, base, d + 1 FROM a JOIN e ON e.node = anc),
    n AS (SELECT node, anc, min(d) AS d FROM a GROUP BY ALL), m AS (SELECT p_partkey AS anc, 'm' || p_size AS name, p_name AS value FROM part),
    x AS (SELECT node, name, value, anc AS owner, d AS distance, row_number() OVER (PARTITION BY node, name ORDER BY d, anc) AS k FROM n JOIN m USING (anc))
    SELECT node, name, value, owner, distance FROM x WHERE k = 1""")
def inherited_members(table) -> DataFrame:
    """Members of classes with two bases each: the nearest definition of a name counts."""
    part = table("part").withColumn("node", F.col("p_partkey"))
    bases = F.array(F.floor(F.col("node") / 2), F.floor(F.col("node") / 3))
    edges = part.filter("node > 0").select("node", F.explode(bases).alias("base"))
    members = part.select("node", F.concat(F.lit("m"), s("p_size")).alias("name"), F.col("p_name").alias("value"))
    return fixpoint.inherited(members, edges, of=part.select("node"))


_SCHEMAS = """s AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 11 = 0 THEN 'input_S' || (p_partkey - 1) WHEN p_partkey % 13 = 0 THEN 'S' || (p_partkey - 1) || '_2' ELSE 'S' || p_partkey END AS name, p_size = 1 AS differs FROM part),
    f AS (SELECT s.name, t.name AS t FROM s JOIN s t ON t.k = s.k // 2 OR t.k = s.k + 1 AND s.k % 8 <> 7)"""


@query(f"""WITH RECURSIVE {_SCHEMAS}, c AS (SELECT name FROM s WHERE differs UNION SELECT f.name FROM c JOIN f ON f.t = c.name),
    x AS (SELECT name, 'input_' || name AS new FROM c), taken AS (SELECT list(n) AS all FROM (SELECT name AS n FROM s UNION ALL SELECT new FROM x)), own AS (SELECT list(name) AS all FROM s)
    SELECT name, CASE WHEN NOT list_contains(own.all, new) THEN new ELSE new || '_' || list_filter(range(2, 50), lambda i: NOT list_contains(taken.all, new || '_' || i))[1] END AS new_name FROM x, taken, own""")
def renamed_schemas(table) -> DataFrame:
    """Schemas whose input differs, by themselves or through references, and names for them that nothing else has."""
    key = F.col("p_partkey")
    name = F.when(key % 11 == 0, F.concat(F.lit("input_S"), s(key - 1))).when(key % 13 == 0, F.concat(F.lit("S"), s(key - 1), F.lit("_2"))).otherwise(F.concat(F.lit("S"), s(key)))
    schemas = table("part").select(key.alias("k"), name.alias("name"), (F.col("p_size") == 1).alias("differs"))
    to = F.explode(F.filter(F.array(F.floor(F.col("k") / 2), F.when(F.col("k") % 8 != 7, F.col("k") + 1)), lambda x: x.isNotNull()))
    references = schemas.select("name", to.alias("at")).join(schemas.select(F.col("k").alias("at"), F.col("name").alias("to")), "at").select("name", "to")
    return fixpoint.renamed(schemas.select("name", "differs"), references)


# --- sweeps ----------------------------------------------------------------------------------------------------------

_MICROS = {"day": 86_400_000_000, "hour": 3_600_000_000}


@query("""WITH t AS (SELECT *, epoch_us(ts) AS u FROM events), i AS (SELECT DISTINCT user_id, 'day' AS kind, u - u % 86400000000 AS a, u - u % 86400000000 + 86400000000 AS b FROM t WHERE event_type = 'purchase'
        UNION ALL SELECT DISTINCT user_id, 'hour', u - u % 3600000000, u - u % 3600000000 + 3600000000 FROM t WHERE event_type = 'click')
    SELECT event_id, kind, CAST(a AS VARCHAR) AS start FROM (SELECT event_id, kind, a, row_number() OVER (PARTITION BY event_id ORDER BY a DESC, b) AS n FROM t LEFT JOIN i ON i.user_id = t.user_id AND a <= u AND u < b WHERE event_type IN ('error', 'view')) WHERE n = 1""")
def innermost_scope(table) -> DataFrame:
    """Days with a purchase and hours with a click are scopes, one within the other; where each error and view stands."""
    events = table("events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))

    def scopes(kind: str, event: str) -> DataFrame:
        start = F.col("at") - F.col("at") % _MICROS[kind]
        return events.filter(F.col("event_type") == event).select("user_id", F.lit(kind).alias("kind"), start.alias("start"), (start + _MICROS[kind]).alias("end")).distinct()

    asked = events.filter("event_type IN ('error', 'view')").select("user_id", "at", "event_id")
    return sweep.innermost(asked, scopes("day", "purchase").unionByName(scopes("hour", "click")), ["user_id"]).select("event_id", "kind", s("start").alias("start"))


@query("SELECT r.event_id AS route, h.event_id AS handler FROM events r JOIN events h ON h.user_id = r.user_id AND h.ts > r.ts WHERE r.event_type = 'signup' AND h.event_type = 'error'")
def handler_pairs(table) -> DataFrame:
    """Each route with the handlers registered after it in its scope."""
    events = table("events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    of = lambda kind, name: events.filter(F.col("event_type") == kind).select("user_id", "at", F.col("event_id").alias(name))
    return closure.handler_pairs(of("signup", "route"), of("error", "handler"), ["user_id"], "at")[0].select("route", "handler")


@query(f"""WITH e AS ({_ENDPOINTS}), s AS (SELECT host, '/' || split_part(path, '/', 2) AS scope, min(page_id) AS declared FROM e GROUP BY ALL)
    SELECT page_id, e.host, scope, declared FROM e JOIN s ON s.host = e.host AND (path = scope OR starts_with(path, scope || '/') OR scope = '/') AND declared < page_id""")
def scopes_before(table) -> DataFrame:
    """Scopes of a router that cover a route and are declared before it."""
    pages = _endpoints(table).select(F.col("page_id").alias("at"), "host", "path")
    scopes = pages.groupBy("host", F.concat(F.lit("/"), F.get(F.split("path", "/"), F.lit(1))).alias("scope")).agg(F.min("at").alias("at"))
    return closure.covering_scopes(pages, scopes, on=["host"], at="at").select(F.col("at").alias("page_id"), "host", "scope", F.col("at_of_scope").alias("declared"))


@query("""WITH s AS (SELECT DISTINCT l_orderkey AS o, l_linenumber % 3 AS p, l_partkey % 200 AS a, l_partkey % 200 + CAST(l_quantity AS BIGINT) AS b FROM lineitem WHERE l_quantity > 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY p, b - a, a) AS r FROM s), x AS (SELECT DISTINCT o, unnest([a, b]) AS pos FROM s), g AS (SELECT o, pos, lead(pos) OVER (PARTITION BY o ORDER BY pos) AS nxt FROM x),
    w AS (SELECT g.o, pos, nxt, min(r) AS r FROM g JOIN r ON r.o = g.o AND a <= pos AND pos < b WHERE nxt IS NOT NULL GROUP BY ALL),
    k AS (SELECT *, CASE WHEN lag(r) OVER q = r AND lag(nxt) OVER q = pos THEN 0 ELSE 1 END AS fresh FROM w WINDOW q AS (PARTITION BY o ORDER BY pos)), n AS (SELECT *, sum(fresh) OVER (PARTITION BY o ORDER BY pos) AS run FROM k),
    f AS (SELECT o, run, min(r) AS r, min(pos) AS a, max(nxt) AS b FROM n GROUP BY ALL), c AS (SELECT *, 60 - coalesce(sum(b - a + 5) OVER (PARTITION BY o ORDER BY r, a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS budget FROM f)
    SELECT o AS l_orderkey, a AS start, CAST(least(b, a + budget) AS BIGINT) AS "end" FROM c WHERE budget > 0""")
def chosen_spans(table) -> DataFrame:
    """Spans of an order's text by priority, length and place, without overlaps, within 60 characters of which each part but
    the first costs 5 more."""
    start = F.col("l_partkey") % 200
    spans = table("lineitem").select("l_orderkey", (F.col("l_linenumber") % 3).alias("priority"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"))
    return sweep.chosen_spans(spans, ["l_orderkey"], 60, 5, bits=12)


# --- lookups ---------------------------------------------------------------------------------------------------------

_USES = """u AS (SELECT c_custkey AS id, 'T' || (c_custkey % 97) AS short, 'pk' || (c_custkey % 40) AS scope, 'pk' || (c_custkey % 11) || '.T' || (c_custkey % 97) AS imported,
        CASE c_custkey % 4 WHEN 0 THEN 'pk3.T' || (c_custkey % 97) ELSE 'T' || (c_custkey % 97) END AS name, c_custkey % 4 = 1 AS imports, c_custkey % 3 > 0 AS wild, 'pk' || (c_custkey % 13) AS w1, 'pk' || (c_custkey % 17) AS w2 FROM customer)"""


@query(f"""WITH {_USES}, y AS (SELECT 'pk' || (p_partkey % 40) || '.T' || (p_partkey % 97) AS symbol, p_size AS place FROM part),
    n AS (SELECT symbol, min(place) AS lo, max(place) AS hi FROM y GROUP BY symbol), h AS (SELECT split_part(symbol, '.', 2) AS short, min(symbol) AS lo, max(symbol) AS hi, min(place) AS plo, max(place) AS phi FROM y GROUP BY 1),
    x AS (SELECT id, 0 AS way, symbol, symbol AS other, lo, hi FROM u JOIN n ON symbol = name AND id % 4 = 0
        UNION ALL SELECT id, 1, symbol, symbol, lo, hi FROM u JOIN n ON symbol = imported AND imports
        UNION ALL SELECT id, 2, symbol, symbol, lo, hi FROM u JOIN n ON symbol = scope || '.' || name
        UNION ALL SELECT id, 3, symbol, symbol, lo, hi FROM u JOIN n ON wild AND (symbol = w1 || '.' || name OR symbol = w2 || '.' || name)
        UNION ALL SELECT id, 4, h.lo, h.hi, plo, phi FROM u JOIN h ON h.short = name),
    b AS (SELECT id, min(way) AS way FROM x GROUP BY id), g AS (SELECT x.id, x.way, min(symbol) AS a, max(other) AS z, min(lo) AS lo, max(hi) AS hi FROM x JOIN b ON b.id = x.id AND b.way = x.way GROUP BY ALL)
    SELECT id AS use, CASE WHEN a = z AND lo = hi THEN a END AS symbol, CASE WHEN a = z AND lo = hi THEN CAST(lo AS VARCHAR) END AS declared_in, CASE WHEN a = z AND lo = hi THEN (['written', 'imported', 'own', 'wildcard', 'short'])[way + 1] END AS by FROM u LEFT JOIN g USING (id)""")
def resolved_names(table) -> DataFrame:
    """Names by import, own scope, wildcard and short name; ambiguous ones stay open."""
    key = F.col("c_custkey")
    cat = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else s(v) for v in x))
    short = cat("T", key % 97)
    uses = table("customer").select(
        key.alias("use"), F.when(key % 4 == 0, cat("pk3.", short)).otherwise(short).alias("name"), cat("pk", key % 40).alias("scope"),
        F.when(key % 4 == 1, F.create_map(short, cat("pk", key % 11, ".", short))).alias("imports"), F.when(key % 3 > 0, F.array(cat("pk", key % 13), cat("pk", key % 17))).alias("wildcards"),
    )
    part = F.col("p_partkey")
    symbols = table("part").select(cat("pk", part % 40, ".T", part % 97).alias("symbol"), s("p_size").alias("declared_in"))
    return names.resolved_names(uses, symbols)


_MODULES = "f AS (SELECT p_partkey AS k, replace(p_name, ' ', '/') || '/m' || (p_partkey % 30) AS path FROM part)"


@query(f"""WITH {_MODULES}, w AS (SELECT DISTINCT unnest([path, split_part(path, '/', 2) || '/' || split_part(path, '/', 3), split_part(path, '/', 3), 'x/' || path]) AS name FROM f)
    SELECT name, arg_max(path || '.py', k) AS path FROM w JOIN f ON path = name OR ends_with(path, '/' || name) GROUP BY name""")
def import_by_suffix(table) -> DataFrame:
    """Modules named by the end of their path; the last file of a name counts."""
    files = table("part").select(F.col("p_partkey").alias("ordinal"), F.concat(F.regexp_replace("p_name", " ", "/"), F.lit("/m"), s(F.col("p_partkey") % 30)).alias("module"))
    part = lambda n: F.get(F.split("module", "/"), F.lit(n))
    wanted = files.select(F.explode(F.array("module", F.concat_ws("/", part(1), part(2)), part(2), F.concat(F.lit("x/"), "module"))).alias("name"))
    return names.by_suffix(wanted, files.withColumn("path", F.concat("module", F.lit(".py"))))


# --- context ---------------------------------------------------------------------------------------------------------


@query("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE b.text <> ''")
def text_owners(table) -> DataFrame:
    """Which documents hold a passage, exactly."""
    needles = table("benchmark").select("item_id", F.col("text").alias("body"))
    return context.contained(needles, table("documents").select("doc_id", F.col("text").alias("body")), needle="item_id", text="doc_id")


def reach(table) -> tuple[DataFrame, DataFrame]:
    """Documents as files that import three others each; their source and language as names."""
    docs = table("documents")
    key = F.col("doc_id")
    edges = docs.select(key.alias("path"), F.explode(F.array(key + 1, key * 2, key * 2 + 1)).alias("target"))
    named = docs.select("doc_id", F.explode(F.array(F.concat(F.lit("l:"), "lang"), F.concat(F.lit("s:"), "source"))).alias("name"))
    origins = docs.select(key.alias("origin"), key.alias("path"))
    asked, held = named.withColumnRenamed("doc_id", "origin"), named.withColumnRenamed("doc_id", "path")
    return context.budgeted_reach(origins, docs.select(key.alias("path"), F.length("text").alias("size")), edges, asked, held)


# --- nodes of JSON ---------------------------------------------------------------------------------------------------

@query("""SELECT event_id, '/k' AS path, json_extract_string(props, '$.k') AS leaf FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL
    UNION ALL SELECT doc_id, '/' || u.k, u.v FROM (SELECT doc_id, unnest([{'k': 'lang', 'v': '"' || lang || '"'}, {'k': 'at/0', 'v': '"' || source || '"'}, {'k': 'at/1/chars', 'v': CAST(n_chars AS VARCHAR)}]) AS u FROM documents)""")
def json_leaves(table) -> DataFrame:
    """Leaves of events' properties, and of documents' figures as nested JSON."""
    events = table("events").select("event_id", F.col("props").alias("value"))
    docs = table("documents").select(F.col("doc_id").alias("event_id"), F.format_string('{"lang": "%s", "at": ["%s", {"chars": %d}]}', "lang", "source", "n_chars").alias("value"))
    return nodes.json_leaves(events, ["event_id"]).unionByName(nodes.json_leaves(docs, ["event_id"]))


@query("""WITH RECURSIVE n AS (SELECT p_brand AS project, p_partkey AS k, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n, p_size FROM part),
    l AS (SELECT a.project, a.k, b.k AS t, a.p_size % 5 AS kind FROM n a LEFT JOIN n b ON b.project = a.project AND b.n = CASE a.p_size % 5 WHEN 1 THEN a.n + 1 WHEN 2 THEN a.n // 2 WHEN 3 THEN a.n - 3 END),
    u AS (SELECT project, k FROM l WHERE kind = 4 OR kind IN (1, 2, 3) AND t IS NULL UNION SELECT l.project, l.k FROM u JOIN l ON l.project = u.project AND l.t = u.k)
    SELECT project, 'S' || k AS name, EXISTS (SELECT 1 FROM u WHERE u.project = n.project AND u.k = n.k) AS unknown FROM n""")
def unknown_schemas(table) -> DataFrame:
    """Schemas that refer to each other, some open and some of a name that isn't there; what can't be known of them."""
    part = table("part").select(F.col("p_brand").alias("project"), F.col("p_partkey").alias("k"), "p_size")
    place = part.withColumn("n", F.row_number().over(Window.partitionBy("project").orderBy("k")))
    kind = F.col("p_size") % 5
    at = F.when(kind == 1, F.col("n") + 1).when(kind == 2, F.floor(F.col("n") / 2)).when(kind == 3, F.col("n") - 3)
    linked = place.withColumn("at", at.cast("int")).join(place.select("project", F.col("n").alias("at"), F.col("k").alias("t")), ["project", "at"], "left")
    ref = F.concat(F.lit('{"$ref": "#/components/schemas/S'), F.coalesce(s("t"), F.lit("-none")), F.lit('"}'))
    text = F.when(kind == 1, ref).when(kind == 2, F.concat(F.lit('{"type": "object", "properties": {"a": {"type": "null"}, "b": '), ref, F.lit("}}"))).when(kind == 3, F.concat(F.lit('{"anyOf": [{"type": "string"}, {"type": "array", "items": '), ref, F.lit("}]}")))
    schema = text.when(kind == 4, F.lit('{"type": "object", "properties": {"a": {"type": "array"}}}')).otherwise(F.lit('{"type": "integer"}'))
    return nodes.unknown_schemas(linked.select("project", F.concat(F.lit("S"), s("k")).alias("name"), schema.alias("schema")), ["project"])


#: A recursion over levels: of each origin what it has met, its last files, what it has used, and what each level took. A
#: level's files, by score and path, are folded one after another, as the share of each hangs on those before it.
@query("""WITH RECURSIVE f AS (SELECT doc_id AS path, CAST(length(text) AS BIGINT) AS size, lang, source FROM documents), e AS (SELECT DISTINCT doc_id AS path, unnest([doc_id + 1, doc_id * 2, doc_id * 2 + 1]) AS target FROM documents),
    s AS (SELECT path AS origin, 0 AS lvl, [path] AS met, [path] AS front, CAST(1 AS BIGINT) AS used, least(6000, size) AS spent, [{'path': path, 'place': CAST(1 AS BIGINT), 'chars': least(6000, size)}] AS got FROM f
        UNION ALL SELECT origin, lvl + 1, met || news, list_transform(r.got, lambda g: g.path), r.used, r.spent, r.got FROM (
            SELECT origin, lvl, met, news, list_reduce(list_transform(line, lambda x: {'p': x.p, 'z': x.z, 'used': used, 'spent': spent, 'got': CAST([] AS STRUCT(path BIGINT, place BIGINT, chars BIGINT)[])}),
                lambda a, b: CASE WHEN a.used < 8 AND a.spent < 24000 THEN {'p': b.p, 'z': b.z, 'used': a.used + 1, 'spent': a.spent + least(b.z, 6000, (24000 - a.spent) // greatest(1, 8 - a.used)),
                    'got': a.got || [{'path': b.p, 'place': a.used + 1, 'chars': least(b.z, 6000, (24000 - a.spent) // greatest(1, 8 - a.used))}]} ELSE a END,
                {'p': CAST(0 AS BIGINT), 'z': CAST(0 AS BIGINT), 'used': used, 'spent': spent, 'got': CAST([] AS STRUCT(path BIGINT, place BIGINT, chars BIGINT)[])}) AS r
            FROM (SELECT origin, lvl, met, used, spent, list(target) AS news, list({'p': target, 'z': f.size} ORDER BY -((f.lang = o.lang)::INT + (f.source = o.source)::INT), target) FILTER (f.size IS NOT NULL) AS line
                FROM (SELECT DISTINCT origin, lvl, met, used, spent, target FROM (SELECT *, unnest(front) AS p FROM s WHERE lvl < 6) q JOIN e ON e.path = q.p WHERE NOT list_contains(met, target)) n JOIN f o ON o.path = origin LEFT JOIN f ON f.path = target
                GROUP BY origin, lvl, met, used, spent) WHERE line IS NOT NULL))
    SELECT origin, u.path, lvl AS depth, u.place, u.chars FROM (SELECT origin, lvl, unnest(got) AS u FROM s)""")
def budgeted_reach(table) -> DataFrame:
    """Documents as files that import three others each, their source and language as names: what each reaches in its budget."""
    taken = reach(table)[0]
    return taken.select("origin", "path", "depth", F.col("place").cast("long").alias("place"), "chars")


# --- reports and sets ------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey AS key FROM lineitem WHERE l_quantity > 25 INTERSECT SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%'")
def shared_keys(table) -> DataFrame:
    """Keys that both snapshots have."""
    urgent = table("orders").filter(F.col("o_orderpriority").like("1%")).select(F.col("o_orderkey").alias("key"))
    return diff.shared(urgent, table("lineitem").filter("l_quantity > 25").select(F.col("l_orderkey").alias("key")), "key")


@query("SELECT CAST(c_nationkey AS VARCHAR) AS project, array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') AS frameworks FROM customer GROUP BY c_nationkey")
def project_frameworks(table) -> DataFrame:
    """The distinct frameworks of each project."""
    found = table("customer").select(s("c_nationkey").alias("project"), F.col("c_mktsegment").alias("framework"))
    return score.frameworks(found).withColumn("frameworks", F.array_join("frameworks", ","))


@query("""WITH n AS (SELECT p_partkey, p_brand, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN upper(p_name[1]) || substr(p_name, 2) WHEN 2 THEN replace(p_name, 'e', 'é') ELSE p_name || (p_partkey % 12) END AS name FROM part)
    SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY name COLLATE en, name, p_partkey) AS place FROM n""")
def locale_order(table) -> DataFrame:
    """Names with cases, accents and digits in the order of a reader, not of their bytes."""
    key, name = F.col("p_partkey"), F.col("p_name")
    written = F.when(key % 4 == 0, F.upper(name)).when(key % 4 == 1, F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 1000))).when(key % 4 == 2, F.regexp_replace(name, "e", "é")).otherwise(F.concat(name, s(key % 12)))
    order = Window.partitionBy("p_brand").orderBy(sources.in_locale(F.col("name")), "name", "p_partkey")
    return table("part").select("p_partkey", "p_brand", written.alias("name")).select("p_partkey", F.row_number().over(order).cast("long").alias("place"))


@query("""WITH w AS (SELECT event_type AS t, 'c' || (user_id % 5) AS c, CASE WHEN value > 99.9 THEN NULL WHEN value < 40 AND user_id % 5 = 1 THEN 'number' WHEN user_id % 5 = 2 AND value < 1 THEN NULL ELSE 'string' END AS k, value > 99.9 AND event_type <> 'view' AS whole FROM events),
    a AS (SELECT t, c, CASE WHEN count(DISTINCT k) = 1 AND count(k) = count(*) THEN '{"type":"' || min(k) || '"}' ELSE '{}' END AS s FROM w GROUP BY ALL), o AS (SELECT t, bool_or(whole) AS o FROM w GROUP BY t)
    SELECT t AS "table", '{"type":"object","properties":{' || string_agg('"' || c || '":' || s, ',' ORDER BY c) || '}' || CASE WHEN bool_or(o) THEN ',"additionalProperties":{}' ELSE '' END || '}' AS schema FROM a JOIN o USING (t) GROUP BY t""")
def table_rows(table) -> DataFrame:
    """What rows of tables without schema are, by all that is written to them."""
    user, value = F.col("user_id") % 5, F.col("value")
    kind = F.when(value > 99.9, None).when((value < 40) & (user == 1), "number").when((user == 2) & (value < 1), None).otherwise("string")
    writes = table("events").select(F.col("event_type").alias("table"), F.concat(F.lit("c"), s(user)).alias("column"), F.concat(F.lit('{"type":"'), kind, F.lit('"}')).alias("type"), ((value > 99.9) & (F.col("event_type") != "view")).alias("whole"))
    return variants.table_rows(writes)


@query("""WITH w AS (SELECT l_orderkey AS k, (['request', 'response', 'parameter', 'constraint'])[l_linenumber % 4 + 1] AS f, l_linenumber AS a, min(l_returnflag) AS v, min(l_quantity) AS q, min(l_shipdate) AS d FROM lineitem GROUP BY ALL),
    c AS (SELECT f, count(*) AS total, count(*) FILTER (k % 19 <> 0 AND q > 2 AND NOT q BETWEEN 20 AND 21) AS ok, count(*) FILTER (k % 19 = 0 OR q <= 2) AS open FROM w GROUP BY f),
    r AS (SELECT count(*) AS routes, count(*) FILTER (o_orderkey % 19 <> 0) AS matched, count(*) FILTER (o_orderkey % 19 <> 0) + count(*) FILTER (o_orderkey % 40 = 0) AS scanned FROM orders),
    t AS (SELECT coalesce(max(total) FILTER (f = 'request'), 0) AS q, coalesce(max(ok) FILTER (f = 'request'), 0) AS qo, coalesce(max(total) FILTER (f = 'response'), 0) AS s, coalesce(max(ok) FILTER (f = 'response'), 0) AS so,
        coalesce(max(total) FILTER (f = 'parameter'), 0) AS p, coalesce(max(ok) FILTER (f = 'parameter'), 0) AS po, coalesce(max(total) FILTER (f = 'constraint'), 0) AS c, coalesce(max(ok) FILTER (f = 'constraint'), 0) AS co, coalesce(sum(open) FILTER (f <> 'constraint'), 0) AS u FROM c),
    x AS (SELECT routes, matched, scanned, round(matched / routes, 4) AS recall, round(matched / scanned, 4) AS precision, round(qo / q, 4) AS request_completeness, round(so / s, 4) AS response_completeness, round(po / p, 4) AS parameter_completeness, round(co / c, 4) AS constraint_accuracy, round(u / (q + s + p), 4) AS unresolved FROM r, t)
    SELECT *, least(recall, precision, request_completeness, response_completeness, parameter_completeness, constraint_accuracy) AS overall, least(recall, precision, request_completeness, response_completeness, parameter_completeness, constraint_accuracy) >= 0.95 AND unresolved <= 0.05 AS accepted FROM x""")
def audit(table) -> DataFrame:
    """A scan against a baseline on all axes: orders as routes, their lines as what is asserted of them."""
    facet = F.get(F.array(*map(F.lit, score.FACETS)), F.col("l_linenumber") % 4)
    lines = table("lineitem").groupBy(F.col("l_orderkey").alias("k"), "l_linenumber").agg(F.min("l_returnflag").alias("value"), F.min("l_quantity").alias("q"))
    lines = lines.select("k", facet.alias("facet"), s("l_linenumber").alias("at"), "value", "q")
    route = lambda df: df.select(F.col("o_orderkey").alias("k"), F.lit("route").alias("facet"), F.lit(None).cast("string").alias("at"), F.lit(None).cast("string").alias("value"))
    orders = table("orders")
    more = orders.filter("o_orderkey % 40 = 0").withColumn("o_orderkey", -F.col("o_orderkey") - 1)
    seen = F.when(F.col("q") <= 2, None).when(F.col("q").between(20, 21), F.concat("value", F.lit("!"))).otherwise(F.col("value"))
    found = route(orders.filter("o_orderkey % 19 <> 0")).unionByName(route(more)).unionByName(lines.filter("k % 19 <> 0").select("k", "facet", "at", seen.alias("value")))
    return score.audit(found, route(orders).unionByName(lines.drop("q")), ["k"])


@query("""WITH p AS (SELECT p_partkey, list_transform(string_split(CASE p_partkey % 3 WHEN 0 THEN '_' || replace(p_name, ' ', '/_') WHEN 1 THEN replace(p_name, ' ', '__') ELSE replace(p_name, ' ', '/') END, '/'), lambda x: x) AS parts FROM part)
    SELECT p_partkey, '/' || array_to_string(list_transform(parts, lambda x: CASE WHEN contains(x, '__') THEN replace(x, '__', ':') WHEN starts_with(x, '_') THEN ':' || substr(x, 2) ELSE x END), '/') AS path FROM p""")
def path_autoload(table) -> DataFrame:
    """Folders of routes as paths: what an underscore marks is a parameter."""
    key, name = F.col("p_partkey"), F.col("p_name")
    folder = F.when(key % 3 == 0, F.concat(F.lit("_"), F.regexp_replace(name, " ", "/_"))).when(key % 3 == 1, F.regexp_replace(name, " ", "__")).otherwise(F.regexp_replace(name, " ", "/"))
    return table("part").select("p_partkey", F.concat(F.lit("/"), F.array_join(F.transform(F.split(folder, "/"), paths.autoload_segment), "/")).alias("path"))


@query(rf"""WITH e AS (SELECT page_id, regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1) AS p FROM pages), r AS (SELECT page_id, regexp_replace(p, '/[0-9]+', '/{{{{id:' || (['int', 'float', 'path', 'uuid', 'other'])[page_id % 5 + 1] || '}}}}/{{{{more}}}}', 'g') AS raw, (['integer', 'number', 'string', 'string', NULL])[page_id % 5 + 1] AS t, CASE WHEN page_id % 5 = 3 THEN 'uuid' END AS f FROM e),
    n AS (SELECT page_id, t, f, len(regexp_extract_all(raw, '\{{id')) AS n FROM r)
    SELECT page_id, CAST(i AS BIGINT) AS pos, CASE WHEN i % 2 = 0 THEN 'id' ELSE 'more' END AS name, CASE WHEN i % 2 = 0 THEN t END AS type, CASE WHEN i % 2 = 0 THEN f END AS format FROM n, unnest(range(0, 2 * n)) u(i)""".replace("{{{{", "{").replace("}}}}", "}").replace("\\{{", "\\{"))
def converter_types(table) -> DataFrame:
    """What converters in a path say of its parameters."""
    path = F.regexp_extract("url", "^https?://[^/?#]+(/[^?#]*)", 1)
    kind = F.get(F.array(*map(F.lit, ("int", "float", "path", "uuid", "other"))), (F.col("page_id") % 5).cast("int"))
    raw = F.regexp_replace(path, F.lit("/[0-9]+"), F.concat(F.lit("/{id:"), kind, F.lit("}/{more}")))
    found = table("pages").select("page_id", F.posexplode(paths.converter_types(raw)).alias("pos", "p"))
    return found.select("page_id", F.col("pos").cast("long").alias("pos"), "p.name", "p.type", "p.format")
