"""The document operators as queries on the given tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacel.functions import columns as C
from stratacel.operators import aggregates as A
from stratacel.operators import compare as D
from stratacel.operators import hierarchy as H
from stratacel.operators import sequence as S
from stratacel.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE[function.__name__] = sql
        return function

    return add


def _clicked():
    return F.when(F.col("event_type") == "click", True).when(F.col("event_type") == "error", False)


@query("""
SELECT event_id, user_id, coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), false) AS enabled
FROM (SELECT *, CASE event_type WHEN 'click' THEN true WHEN 'error' THEN false END AS e FROM events)
""")
def state_carry_forward(spark: SparkSession, sf: str) -> DataFrame:
    """Explicit states carried forward (WIN-01)."""
    out = S.carry_forward(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], _clicked(), F.lit(False), "enabled")
    return out.select("event_id", "user_id", "enabled")


@query("""
WITH days AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), users AS (SELECT DISTINCT user_id FROM events),
rec AS (SELECT user_id, CAST(ts AS DATE) AS day, bool_or(event_type = 'click') AS enable FROM events GROUP BY ALL)
SELECT u.user_id, d.day::VARCHAR AS day, rec.user_id IS NOT NULL AS record_present, coalesce(rec.enable, false) AS enabled
FROM users u CROSS JOIN days d LEFT JOIN rec ON rec.user_id = u.user_id AND rec.day = d.day
""")
def state_reset_slots(spark: SparkSession, sf: str) -> DataFrame:
    """A dense grid without inheritance (WIN-01 slot policy, JN-04)."""
    events = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    record = events.groupBy("user_id", "day").agg(F.bool_or(F.col("event_type") == "click").alias("enable"))
    days = F.broadcast(events.groupBy().agg(F.collect_set("day").alias("days")))  # one row of calendar days
    grid = events.select("user_id").distinct().join(days).select("user_id", F.explode("days").alias("day"))
    out = grid.join(record, ["user_id", "day"], "left")
    return out.select("user_id", F.col("day").cast("string").alias("day"), F.col("enable").isNotNull().alias("record_present"), F.coalesce("enable", F.lit(False)).alias("enabled"))


@query("""
WITH s AS (SELECT event_id, user_id, ts, coalesce(last_value(CASE event_type WHEN 'click' THEN true WHEN 'error' THEN false END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), false) AS enabled FROM events),
e AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR lag(enabled) OVER w IS DISTINCT FROM enabled THEN enabled END AS stored FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id, enabled, stored, last_value(stored IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS decoded FROM e
""")
def state_sparse_encode(spark: SparkSession, sf: str) -> DataFrame:
    """A state series stored as its changes, and read back (WIN-11)."""
    keys, order = ["user_id"], ["ts", "event_id"]
    dense = S.carry_forward(table(spark, sf, "events"), keys, order, _clicked(), F.lit(False), "enabled")
    stored = S.sparse_encode(dense, keys, order, "enabled", "stored")
    out = S.carry_forward(stored, keys, order, F.col("stored"), F.lit(None).cast("boolean"), "decoded")
    return out.select("event_id", "user_id", "enabled", "stored", "decoded")


@query("""
SELECT user_id, count(*) FILTER (WHERE moved)::BIGINT AS changes FROM (
  SELECT user_id, row_number() OVER w > 1 AND lag(event_type) OVER w IS DISTINCT FROM event_type AS moved
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) GROUP BY user_id
""")
def state_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Adjacent rows that differ (FLT-05, WIN-03, ARR-02)."""
    return S.state_changes(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], ["event_type"], "changes")


@query("""
WITH a AS (SELECT user_id, event_type, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events),
r AS (SELECT *, pos - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS run FROM a)
SELECT user_id, event_type, min(pos)::BIGINT AS from_index, max(pos)::BIGINT AS to_index, count(*)::BIGINT AS n FROM r GROUP BY user_id, event_type, run
""")
def contiguous_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Gaps and islands (WIN-02)."""
    return S.contiguous_ranges(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@query("""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1)::BIGINT AS place FROM lineitem
""")
def dense_order(spark: SparkSession, sf: str) -> DataFrame:
    """Places within a group from zero (WIN-04)."""
    out = S.dense_order(table(spark, sf, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"], "place")
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "place")


@query("""
SELECT doc_id, CASE WHEN min(doc_id) OVER w <> doc_id THEN min(doc_id) OVER w END AS linked_to FROM documents WINDOW w AS (PARTITION BY source, sha256(text))
""")
def content_links(spark: SparkSession, sf: str) -> DataFrame:
    """The first equal content (WIN-05, JN-07): equality is settled by hash, texts aren't shuffled."""
    docs = table(spark, sf, "documents").select("doc_id", "source", F.sha2("text", 256).alias("content"))
    return S.first_equal(docs, ["source"], ["content"], "doc_id", "linked_to").select("doc_id", "linked_to")


@query("""
SELECT doc_id, (dense_rank() OVER (PARTITION BY page_id ORDER BY f) - 1)::BIGINT AS variant FROM (
  SELECT doc_id, page_id, min(doc_id) OVER (PARTITION BY page_id, sha256(text)) AS f FROM documents)
""")
def variant_index(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct contents of a page by first appearance (WIN-09, SLV-09)."""
    docs = table(spark, sf, "documents").select("doc_id", "page_id", F.sha2("text", 256).alias("content"))
    return S.variant_index(docs, ["page_id"], ["content"], "doc_id", "variant").select("doc_id", "variant")


@query("""
SELECT n_nationkey, CASE WHEN count(*) OVER (PARTITION BY n_regionkey) > 1 THEN concat(n_regionkey, ' ', row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)) ELSE n_regionkey::VARCHAR END AS numbered,
CASE WHEN row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) = 1 THEN n_regionkey::VARCHAR ELSE concat(n_regionkey, ' (', row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), ')') END AS bracketed FROM nation
""")
def ordinal_names(spark: SparkSession, sf: str) -> DataFrame:
    """Ordinals that tell equal names apart (WIN-06, WIN-07)."""
    nation = table(spark, sf, "nation").withColumn("name", F.col("n_regionkey").cast("string"))
    both = S.ordinal_suffix(S.ordinal_suffix(nation, [], "name", ["n_nationkey"], "numbered", False), [], "name", ["n_nationkey"], "bracketed", True)
    return both.select("n_nationkey", "numbered", "bracketed")


@query("""
SELECT s_nationkey, s_suppkey, round(greatest(s_acctbal - coalesce(nxt, 0), 0), 2) AS margin FROM (
  SELECT *, row_number() OVER w AS r, lead(s_acctbal) OVER w AS nxt FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey)) WHERE r = 1
""")
def best_margin(spark: SparkSession, sf: str) -> DataFrame:
    """The best of a group and its lead (WIN-08, ORD-03, ORD-10)."""
    out = S.best_margin(table(spark, sf, "supplier"), ["s_nationkey"], "s_acctbal", ["s_suppkey"], "margin")
    return out.select("s_nationkey", "s_suppkey", F.round("margin", 2).alias("margin"))


@query("SELECT n_nationkey, (n_nationkey + 25 - 7) % 25 AS place FROM nation")
def rotated_order(spark: SparkSession, sf: str) -> DataFrame:
    """An order that starts at an anchor and wraps (WIN-10)."""
    return table(spark, sf, "nation").select("n_nationkey", S.rotated_position(F.col("n_nationkey"), F.lit(7), F.lit(25)).alias("place"))


@query("""
SELECT l_orderkey, l_linenumber, ends, next_start FROM (SELECT l_orderkey, l_linenumber, l_linenumber + 1 AS ends, lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS next_start
  FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) WHERE next_start <> ends
""")
def no_gap_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Sections that aren't followed at once (VAL-15)."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") + 1).alias("ends")).distinct()
    return S.gaps(lines, ["l_orderkey"], "l_linenumber", "ends")


_KIND = ["forward", "reverse", "pingpong", "pingpong_reverse"]


@query("""
WITH t AS (SELECT n_nationkey, n_regionkey AS first, n_regionkey + n_nationkey % 6 AS last, n_nationkey % 4 AS kind FROM nation),
o AS (SELECT n_nationkey, CASE kind WHEN 0 THEN range(first, last + 1) WHEN 1 THEN list_reverse(range(first, last + 1))
  WHEN 2 THEN list_concat(range(first, last + 1), list_reverse(range(first + 1, last))) ELSE list_concat(list_reverse(range(first, last + 1)), range(first + 1, last)) END AS fs FROM t)
SELECT n_nationkey, (unnest(range(0, len(fs))))::INT AS position, unnest(fs)::INT AS frame FROM o
""")
def playback_expand(spark: SparkSession, sf: str) -> DataFrame:
    """Frame ranges as they play (ARR-01)."""
    key = F.col("n_nationkey")
    tags = table(spark, sf, "nation").select(
        "n_nationkey", F.col("n_regionkey").alias("first"), (F.col("n_regionkey") + key % 6).alias("last"), F.element_at(F.array(*map(F.lit, _KIND)), key % 4 + 1).alias("kind")
    )
    return S.playback(tags, "first", "last", "kind").select("n_nationkey", "position", "frame")


@query("""
SELECT event_id, last_value(p IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
first_value(p IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after
FROM (SELECT *, CASE WHEN event_type = 'purchase' THEN event_id END AS p FROM events)
""")
def nearest_confirmed(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest anchors on both sides (JN-13)."""
    anchor = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return S.nearest_both_sides(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], anchor, "before", "after").select("event_id", "before", "after")


@query("""
WITH r AS (SELECT o_orderkey, o_orderpriority AS code, o_orderstatus AS disposition, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_orderkey) AS rk FROM orders)
SELECT code, disposition, count(*)::BIGINT AS n, min(o_orderkey) AS first_seen, string_agg(o_orderkey::VARCHAR, ',' ORDER BY rk) FILTER (WHERE rk <= 8) AS locations FROM r GROUP BY code, disposition
""")
def bounded_issue_report(spark: SparkSession, sf: str) -> DataFrame:
    """Counts with the first eight places (AGG-01, VAL-09, VAL-10, ORD-09)."""
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("code"), F.col("o_orderstatus").alias("disposition"))
    return A.bounded_report(orders, ["code", "disposition"], "o_orderkey", F.col("o_orderkey").cast("string"))


_PAIRS = """
WITH t AS (SELECT l_orderkey AS g, p_brand AS item, min(l_linenumber) AS at FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
v AS (SELECT a.item AS lo, b.item AS hi, (count(*) FILTER (WHERE a.at < b.at))::BIGINT AS forward, (count(*) FILTER (WHERE a.at > b.at))::BIGINT AS reverse
  FROM t a JOIN t b ON a.g = b.g AND a.item < b.item GROUP BY ALL)
"""


def _votes(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("item"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    seen = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey", "item").agg(F.min("l_linenumber").alias("at"))
    return A.pair_votes(seen, ["l_orderkey"], "item", "at")


@query(_PAIRS + "SELECT lo, hi, forward, reverse FROM v")
def pair_order_votes(spark: SparkSession, sf: str) -> DataFrame:
    """Votes for the order of two items (AGG-02, JN-11)."""
    return _votes(spark, sf)


@query(_PAIRS + """SELECT lo, hi, greatest(forward, reverse) AS winner, least(forward, reverse) AS loser,
  (greatest(forward, reverse) > 0 AND (least(forward, reverse) = 0 OR (greatest(forward, reverse) >= 2 AND greatest(forward, reverse) >= least(forward, reverse) + 2 AND 3 * greatest(forward, reverse) >= 2 * (forward + reverse)))) AS confident FROM v""")
def confident_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Votes that decide (ORD-04's test)."""
    winner, loser = F.greatest("forward", "reverse"), F.least("forward", "reverse")
    return _votes(spark, sf).select("lo", "hi", winner.alias("winner"), loser.alias("loser"), A.confident(winner, loser).alias("confident"))


@query("""
WITH c AS (SELECT o_custkey, o_orderpriority AS ch, count(*) AS votes FROM orders GROUP BY ALL),
t AS (SELECT *, sum(votes) OVER (PARTITION BY o_custkey) AS total, rank() OVER (PARTITION BY o_custkey ORDER BY votes DESC) AS rk FROM c),
b AS (SELECT o_custkey, min(ch) AS ch, count(*) AS leaders, max(votes) AS votes, max(total) AS total FROM t WHERE rk = 1 GROUP BY o_custkey)
SELECT o_custkey, CASE WHEN leaders = 1 AND votes * 3 >= total THEN ch END AS choice, votes::BIGINT AS votes, total::BIGINT AS total FROM b
""")
def majority_group(spark: SparkSession, sf: str) -> DataFrame:
    """Majorities with ties and a threshold (AGG-03)."""
    return A.majority(table(spark, sf, "orders"), ["o_custkey"], "o_orderpriority", (1, 3))


@query("""
SELECT l_orderkey, l_quantity AS median FROM (SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_partkey) AS r, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) WHERE r = n // 2 + 1
""")
def upper_median(spark: SparkSession, sf: str) -> DataFrame:
    """The upper median by rank (AGG-04)."""
    return A.upper_median(table(spark, sf, "lineitem"), ["l_orderkey"], "l_quantity", ["l_partkey"], "median")


@query("""
SELECT o_custkey, string_agg(s || o, ',' ORDER BY s, o) AS profile FROM (SELECT DISTINCT o_custkey, o_orderstatus AS s, o_orderpriority AS o FROM orders) GROUP BY o_custkey
""")
def attribute_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct attribute combinations, sorted (AGG-05, AGG-06)."""
    out = A.profile(table(spark, sf, "orders"), ["o_custkey"], ["o_orderstatus", "o_orderpriority"], "p")
    return out.select("o_custkey", F.array_join(F.transform("p", lambda x: F.concat(x.o_orderstatus, x.o_orderpriority)), ",").alias("profile"))


@query("""
WITH a AS (SELECT DISTINCT n_regionkey AS parent, c_custkey % 3 AS child, c_custkey % 3 * 100 + n_nationkey AS slot FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION SELECT DISTINCT 9, c_custkey % 2, c_nationkey FROM customer),
s AS (SELECT parent, slot, count(*) AS k FROM a GROUP BY ALL)
SELECT p.parent, (SELECT count(DISTINCT child) FROM a WHERE a.parent = p.parent)::BIGINT AS children, count(*)::BIGINT AS slots,
  max(k) = 1 AND count(*) >= 2 AND (SELECT count(DISTINCT child) FROM a WHERE a.parent = p.parent) >= 2 AS exclusive FROM s p GROUP BY p.parent
""")
def exclusive_siblings(spark: SparkSession, sf: str) -> DataFrame:
    """Children that are never active together (AGG-07, JN-14)."""
    customer = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    own = customer.select(F.col("n_regionkey").alias("parent"), (F.col("c_custkey") % 3).alias("child"), (F.col("c_custkey") % 3 * 100 + F.col("n_nationkey")).alias("slot"))
    mixed = customer.select(F.lit(9).alias("parent"), (F.col("c_custkey") % 2).alias("child"), F.col("c_nationkey").cast("bigint").alias("slot"))
    return A.exclusive_siblings(own.unionByName(mixed), "parent", "child", "slot")


@query("""
SELECT day::VARCHAR AS day, named, n FROM (SELECT CAST(ts AS DATE) AS day, (count(*) FILTER (WHERE event_type <> 'error'))::BIGINT AS named, count(*)::BIGINT AS n FROM events GROUP BY ALL) ORDER BY named DESC, n DESC, day LIMIT 1
""")
def anchor_pick(spark: SparkSession, sf: str) -> DataFrame:
    """The best slot by three keys (ORD-01); a limit is the operator."""
    days = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count_if(F.col("event_type") != "error").alias("named"), F.count("*").alias("n"))
    return A.anchor_pick(days, "named", "n", "day").withColumn("day", F.col("day").cast("string"))


@query("""
SELECT l_orderkey, min(l_linenumber) AS low, max(l_linenumber) AS high, count(*)::BIGINT AS n,
  max(l_linenumber) - min(l_linenumber) + 1 = count(DISTINCT l_linenumber) AND count(*) = count(DISTINCT l_linenumber) AS complete FROM lineitem GROUP BY l_orderkey
""")
def marker_completeness(spark: SparkSession, sf: str) -> DataFrame:
    """Positions that fill their range once (JN-12, SET-04)."""
    return A.complete_interval(table(spark, sf, "lineitem"), ["l_orderkey"], "l_linenumber")


_TREE = """
WITH RECURSIVE nodes AS (SELECT 'r' || r_regionkey AS node, NULL AS parent, r_regionkey::BIGINT AS ordinal, true AS on_ FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey, n_nationkey % 5 <> 0 FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_custkey, c_acctbal > 0 FROM customer),
flat AS (SELECT node, 0 AS depth, ordinal::VARCHAR AS path, on_ FROM nodes WHERE parent IS NULL
  UNION ALL SELECT c.node, f.depth + 1, f.path || '/' || c.ordinal, f.on_ AND c.on_ FROM nodes c JOIN flat f ON c.parent = f.node)
"""


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Regions, nations and customers as one tree of numbered nodes."""
    rows = [
        ("region", F.lit(0), "r_regionkey", F.lit(None), F.lit(True), "r"),
        ("nation", F.lit(1), "n_nationkey", F.col("n_regionkey") * 4, F.col("n_nationkey") % 5 != 0, "n"),
        ("customer", F.lit(2), "c_custkey", F.col("c_nationkey") * 4 + 1, F.col("c_acctbal") > 0, "c"),
    ]
    out = None
    for name, kind, key, parent, on, letter in rows:
        part = table(spark, sf, name).select(
            F.lit("all").alias("doc_id"), (F.col(key).cast("bigint") * 4 + kind).alias("id"), parent.cast("bigint").alias("parent"),
            F.col(key).cast("bigint").alias("ordinal"), on.alias("on"), F.concat(F.lit(letter), F.col(key).cast("string")).alias("node"),
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(_TREE + "SELECT node, depth, path FROM flat")
def tree_flatten(spark: SparkSession, sf: str) -> DataFrame:
    """Depth and path of every node (TRE-01, PRJ-07)."""
    nodes = _nodes(spark, sf)
    return H.flatten(nodes, "id", "parent", "ordinal").join(nodes.select("id", "node"), "id").select("node", "depth", "path")


@query(_TREE + "SELECT node, on_ AS visible FROM flat")
def effective_flag_by_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    """A flag that holds only where all ancestors' do (FLT-01, TRE-03)."""
    nodes = _nodes(spark, sf)
    closed = H.closure(H.flatten(nodes, "id", "parent", "ordinal"), "id")
    return H.all_above(closed, nodes, "id", "on", ["doc_id"]).join(nodes.select("id", "node"), "id").select("node", F.col("on").alias("visible"))


@query(_TREE.replace("flat AS", "unused AS").rstrip().rstrip(")") + """),
up AS (SELECT node AS low, node AS high FROM nodes UNION ALL SELECT u.low, n.parent FROM up u JOIN nodes n ON n.node = u.high WHERE n.parent IS NOT NULL)
SELECT up.high AS node, bool_or(n.on_) AS active, (count(*) FILTER (WHERE n.on_))::BIGINT AS active_below FROM up JOIN nodes n ON n.node = up.low GROUP BY up.high""")
def descendant_activity(spark: SparkSession, sf: str) -> DataFrame:
    """What holds anywhere below (FLT-02, TRE-04)."""
    nodes = _nodes(spark, sf)
    closed = H.closure(H.flatten(nodes, "id", "parent", "ordinal"), "id")
    return H.any_below(closed, nodes, "id", "on", ["doc_id"]).join(nodes.select("id", "node"), "id").select("node", F.col("on").alias("active"), F.col("on_below").alias("active_below"))


@query(_TREE.replace("flat AS", "unused AS").rstrip().rstrip(")") + """),
up AS (SELECT node AS low, node AS high FROM nodes WHERE node LIKE 'c%' AND on_ UNION ALL SELECT u.low, n.parent FROM up u JOIN nodes n ON n.node = u.high WHERE n.parent IS NOT NULL)
SELECT DISTINCT high AS node FROM up""")
def pruned_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Leaves that count and the groups that lead to one (FLT-21, TRE-12)."""
    nodes = _nodes(spark, sf)
    closed = H.closure(H.flatten(nodes, "id", "parent", "ordinal"), "id")
    keep = F.col("node").startswith("c") & F.col("on")
    return H.prune(closed, nodes, "id", keep, ["doc_id"]).select("node")


@query(r"""
SELECT doc_id, trim(regexp_replace(lower(title), '\s+', ' ', 'g')) AS name, regexp_matches(trim(regexp_replace(lower(title), '\s+', ' ', 'g')), '^(图层|layer) [0-9]+$') AS generic FROM documents
""")
def name_family(spark: SparkSession, sf: str) -> DataFrame:
    """Normalised names (STR-01, FLT-09)."""
    name = C.normalized_name(F.col("title"))
    return table(spark, sf, "documents").select("doc_id", name.alias("name"), C.is_generic_name(name).alias("generic"))


@query("""
SELECT p_partkey, (CASE WHEN p_size = 0 THEN 0 ELSE round(least(p_size, 25) / greatest(p_size, 25)::DOUBLE * 10) END)::BIGINT AS ratio,
  least(20, ((CASE WHEN p_size = 0 THEN 0 ELSE round(least(p_size, 25) / greatest(p_size, 25)::DOUBLE * 10) END) + 10)::BIGINT // 2
    + (20 - least(20, least(abs(p_partkey % 40 - 10), 32) + least(abs(p_size - 20), 32))) // 2)::BIGINT AS geometry FROM part
""")
def ratio_geometry_score(spark: SparkSession, sf: str) -> DataFrame:
    """Likeness of sizes and places (MTH-01, MTH-02)."""
    size, key = F.col("p_size"), F.col("p_partkey")
    geometry = C.geometry_score(size, F.lit(7), key % 40, size, F.lit(25), F.lit(7), F.lit(10), F.lit(20))
    return table(spark, sf, "part").select("p_partkey", C.ratio_score(size, F.lit(25)).alias("ratio"), geometry.alias("geometry"))


@query("""
WITH b AS (SELECT o_custkey, o_orderkey, (epoch(o_orderdate) / 86400)::BIGINT AS lo, (epoch(o_orderdate) / 86400)::BIGINT + 1 + o_orderkey % 90 AS hi, o_totalprice AS price FROM orders)
SELECT x.o_orderkey AS a, y.o_orderkey AS b FROM b x JOIN b y ON x.o_custkey = y.o_custkey AND x.o_orderkey < y.o_orderkey AND x.lo < y.hi AND y.lo < x.hi AND abs(x.price - y.price) < 50000
""")
def bbox_overlap_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Overlapping boxes by a grid (JN-10's prefilter)."""
    day = F.unix_date(F.to_date("o_orderdate")).cast("bigint")
    boxes = table(spark, sf, "orders").select("o_custkey", "o_orderkey", day.alias("lo"), (day + 1 + F.col("o_orderkey") % 90).alias("hi"), F.col("o_totalprice").alias("price"))
    near = (F.abs(F.col("a_price") - F.col("b_price")) < 50000) & (F.col("a_o_orderkey") < F.col("b_o_orderkey"))
    return D.overlap_join(boxes, boxes, ["o_custkey"], "lo", "hi", 90, near).select(F.col("a_o_orderkey").alias("a"), F.col("b_o_orderkey").alias("b"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def unobserved(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that nothing refers to (JN-16)."""
    urgent = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'")
    return table(spark, sf, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""
WITH s AS (SELECT lang, list(DISTINCT source) AS f FROM documents WHERE lang IS NOT NULL GROUP BY lang)
SELECT x, count(*)::BIGINT AS langs FROM (
  (SELECT page_id AS x FROM documents WHERE lang = 'en' INTERSECT SELECT page_id FROM documents WHERE lang = 'de')
  UNION ALL (SELECT page_id FROM documents WHERE lang = 'en' EXCEPT SELECT page_id FROM documents WHERE lang = 'fr')
  UNION ALL (SELECT page_id FROM documents WHERE lang = 'en' UNION SELECT page_id FROM documents WHERE lang = 'de')) GROUP BY x
""")
def key_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Intersection, difference and union of key sets (SET-01, SET-02, SET-05, DIF-03)."""
    docs = table(spark, sf, "documents").select(F.col("page_id").alias("x"), "lang")
    en, de, fr = (docs.where(F.col("lang") == k).select("x") for k in ("en", "de", "fr"))
    every = en.intersect(de).unionByName(en.subtract(fr)).unionByName(en.unionByName(de).distinct())
    return every.groupBy("x").agg(F.count("*").alias("langs"))


@query("""
SELECT 'duplicate' AS finding, count(*)::BIGINT AS n FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'dangling', count(*)::BIGINT FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'collision', count(*)::BIGINT FROM orders WHERE o_orderkey IN (SELECT p_partkey FROM part)
""")
def integrity_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Repeated keys, references into nothing, ids of two kinds (VAL-07, VAL-08, JN-03)."""
    lines, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    counts = {
        "duplicate": D.duplicate_keys(lines, ["l_orderkey", "l_linenumber"]),
        "dangling": D.dangling(lines, "l_orderkey", orders, "o_orderkey"),
        "collision": orders.join(table(spark, sf, "part"), F.col("o_orderkey") == F.col("p_partkey"), "left_semi"),
    }
    out = None
    for name, rows in counts.items():
        part = rows.groupBy().agg(F.count("*").alias("n")).select(F.lit(name).alias("finding"), "n")
        out = part if out is None else out.unionByName(part)
    return out


_OTHER = "(SELECT c_custkey + CASE WHEN c_custkey % 97 = 0 THEN 1000000 ELSE 0 END AS c_custkey, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment, c_nationkey + CASE WHEN c_custkey % 13 = 0 THEN 1 ELSE 0 END AS c_nationkey FROM customer)"


@query(f"""
SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN b.c_custkey IS NULL THEN 'missing_in_b' WHEN a.c_custkey IS NULL THEN 'missing_in_a'
  ELSE concat_ws(',', CASE WHEN a.c_mktsegment IS DISTINCT FROM b.c_mktsegment THEN 'c_mktsegment' END, CASE WHEN a.c_nationkey IS DISTINCT FROM b.c_nationkey THEN 'c_nationkey' END) END AS difference
FROM customer a FULL JOIN {_OTHER} b ON a.c_custkey = b.c_custkey
WHERE a.c_custkey IS NULL OR b.c_custkey IS NULL OR a.c_mktsegment IS DISTINCT FROM b.c_mktsegment OR a.c_nationkey IS DISTINCT FROM b.c_nationkey
""")
def row_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Full outer comparison by key (JN-21, DIF-02, VAL-01, VAL-14)."""
    a, key = table(spark, sf, "customer"), F.col("c_custkey")
    b = a.select(
        (key + F.when(key % 97 == 0, 1000000).otherwise(0)).alias("c_custkey"), F.when(key % 11 != 0, F.col("c_mktsegment")).alias("c_mktsegment"),
        (F.col("c_nationkey") + F.when(key % 13 == 0, 1).otherwise(0)).alias("c_nationkey"),
    )
    return D.row_diff(a, b, ["c_custkey"], ["c_mktsegment", "c_nationkey"])


@query("""
SELECT event_id, round(v * 255)::INT AS quantised, v * 255 <> round(v * 255) AS lossy FROM (SELECT event_id, coalesce(value / 1000, 1.0) AS v FROM events)
""")
def opacity_quantise(spark: SparkSession, sf: str) -> DataFrame:
    """Values 0 to 1 in 256 steps, and what is lost (PRJ-05, PRJ-06)."""
    value = F.col("value") / 1000
    return table(spark, sf, "events").select("event_id", C.quantised_opacity(value).alias("quantised"), C.opacity_loses(value).alias("lossy"))
