"""Manifests, routes, guards, settings and validated joins. Documents stand for images: their digests are the files'."""

from __future__ import annotations

import json
import platform
import uuid
from importlib.metadata import version

from pyspark.sql import functions as F

from ..functions.scalar import identity
from ..operators import governance, links, manifests
from ..sources import files
from ..sources.scratch import shared_dir, stored
from .base import predictions, query, six

_M = """WITH m AS (SELECT doc_id, substr(sha256(concat_ws('|', source, doc_id)), 1, 24) AS plain_id, sha256(coalesce(text, '')) AS sha256, coalesce(source, '') AS object, doc_id % 6 = 0 AS odd FROM documents),
f AS (SELECT doc_id, object, sha256, CASE WHEN doc_id % 97 = 0 THEN 'x' || plain_id ELSE plain_id END AS image_id, CASE WHEN doc_id % 89 = 0 THEN 'other' ELSE sha256 END AS duplicate_group,
  CASE WHEN doc_id % 107 = 0 THEN '' ELSE object || '/Data/Images/' || CASE WHEN odd AND doc_id % 13 <> 0 THEN 'Anomaly' ELSE 'Normal' END || '/' || doc_id || CASE WHEN doc_id % 109 = 0 THEN '.txt' ELSE '.JPG' END END AS image_path,
  CASE WHEN odd AND doc_id % 7 <> 0 THEN object || '/Data/Masks/Anomaly/' || doc_id || '.png' ELSE '' END AS mask_path,
  CASE WHEN doc_id % 103 = 0 THEN 'odd' WHEN odd THEN 'anomaly' ELSE 'normal' END AS label, CASE WHEN doc_id % 3 = 0 THEN 'test' ELSE 'train' END AS official_split,
  CASE WHEN doc_id % 101 = 0 THEN 'holdout' WHEN doc_id % 3 = 0 THEN 'test' WHEN doc_id % 5 = 0 THEN 'calibration' ELSE 'fit' END AS split FROM m)"""


def _manifest(spark, sf_dir):
    d = files.read_table(spark, sf_dir, "documents").withColumns({"object": F.coalesce("source", F.lit("")), "sha256": F.sha2(F.coalesce("text", F.lit("")), 256), "odd": F.col("doc_id") % 6 == 0})
    i, at = F.col("doc_id"), lambda n: F.col("doc_id") % n == 0
    plain, name = identity(F.col("source"), i.cast("string")), i.cast("string")
    folder = F.when(F.col("odd") & ~at(13), "Anomaly").otherwise("Normal")
    path = F.concat("object", F.lit("/Data/Images/"), folder, F.lit("/"), name, F.when(at(109), ".txt").otherwise(".JPG"))
    return d.select(
        i, "object", "sha256", F.when(at(97), F.concat(F.lit("x"), plain)).otherwise(plain).alias("image_id"), F.when(at(89), "other").otherwise(F.col("sha256")).alias("duplicate_group"),
        F.when(at(107), "").otherwise(path).alias("image_path"), F.when(F.col("odd") & ~at(7), F.concat("object", F.lit("/Data/Masks/Anomaly/"), name, F.lit(".png"))).otherwise("").alias("mask_path"),
        F.when(at(103), "odd").when(F.col("odd"), "anomaly").otherwise("normal").alias("label"), F.when(at(3), "test").otherwise("train").alias("official_split"),
        F.when(at(101), "holdout").when(at(3), "test").when(at(5), "calibration").otherwise("fit").alias("split"),
    )


def _each(rules: dict[str, str], key: str) -> str:
    return " UNION ALL ".join(f"SELECT '{rule}' AS rule, CAST({key} AS VARCHAR) AS id FROM f WHERE {bad}" for rule, bad in rules.items())


_ROWS = _each(
    {
        "split_known": "split NOT IN ('fit', 'calibration', 'test')", "official_split_known": "official_split NOT IN ('train', 'test')", "image_id_form": "NOT regexp_full_match(image_id, '[0-9a-f]{24}')",
        "sha256_form": "NOT regexp_full_match(sha256, '[0-9a-f]{64}')", "group_is_sha256": "sha256 <> duplicate_group", "path_given": "image_path = ''", "label_known": "label NOT IN ('normal', 'anomaly')",
        "only_normals_train": "split <> 'test' AND label <> 'normal'", "anomaly_has_mask": "label = 'anomaly' AND mask_path = ''", "official_test_kept": "official_split = 'test' AND split <> 'test'",
        "official_train_kept": "official_split = 'train' AND split = 'test'",
    },
    "image_id",
)
_GROUPS = " UNION ALL ".join(
    f"SELECT '{rule}', {key} FROM f GROUP BY {key} HAVING {bad}"
    for rule, key, bad in (("unique_id", "image_id", "count(*) > 1"), ("unique_path", "image_path", "count(*) > 1"), ("one_label_per_file", "sha256", "count(DISTINCT label) > 1"), ("one_split_per_file", "sha256", "count(DISTINCT split) > 1"))
)


@query("F5", f"{_M} {_ROWS} UNION ALL {_GROUPS}")
def manifest_violations(spark, sf_dir):
    """All sixteen rules on a manifest with faults of each kind."""
    return manifests.manifest_violations(_manifest(spark, sf_dir))


_NORMAL = """, n AS (SELECT image_id, sha256, CASE WHEN doc_id % 41 = 0 THEN 'anomaly' ELSE 'normal' END AS label, CASE WHEN doc_id % 43 = 0 THEN 'scratch' ELSE '' END AS defect_types, '' AS mask_path,
CASE WHEN doc_id % 3 = 0 THEN 'normal_test' WHEN doc_id % 5 = 0 THEN 'calibration' ELSE 'fit' END AS split FROM f)"""


def _normals(spark, sf_dir):
    at = lambda n: F.col("doc_id") % n == 0
    return _manifest(spark, sf_dir).select(
        "image_id", "sha256", F.when(at(41), "anomaly").otherwise("normal").alias("label"), F.when(at(43), "scratch").otherwise("").alias("defect_types"), F.lit("").alias("mask_path"),
        F.when(at(3), "normal_test").when(at(5), "calibration").otherwise("fit").alias("split"), "doc_id",
    )


@query("F6", _M + _NORMAL + """ SELECT 'only_normal' AS rule, image_id AS id FROM n WHERE label <> 'normal' UNION ALL SELECT 'no_defect_types', image_id FROM n WHERE defect_types <> ''
UNION ALL SELECT 'unique_id', image_id FROM n GROUP BY image_id HAVING count(*) > 1 UNION ALL SELECT 'one_split_per_file', sha256 FROM n GROUP BY sha256 HAVING count(DISTINCT split) > 1""")
def normal_violations(spark, sf_dir):
    return manifests.normal_violations(_normals(spark, sf_dir), ["mask_path", "mask_sha256", "defect_types"])


@query("F7", _M + _NORMAL + """, t AS (SELECT f.image_id, CASE WHEN doc_id % 51 = 0 THEN sha256('changed' || doc_id) ELSE f.sha256 END AS sha256, CASE WHEN doc_id % 4 = 0 THEN 'anomaly' ELSE 'normal' END AS label FROM f WHERE doc_id % 3 = 0 OR doc_id % 77 = 1),
h AS (SELECT image_id, sha256 FROM n WHERE split = 'normal_test'), s AS (SELECT image_id, sha256 FROM t WHERE label = 'normal'), b AS (SELECT * FROM n WHERE split IN ('fit', 'calibration'))
SELECT 'unique_id' AS rule, image_id AS id FROM t GROUP BY image_id HAVING count(*) > 1 UNION ALL SELECT 'unique_file', sha256 FROM t GROUP BY sha256 HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'held_out_missing', image_id FROM (SELECT * FROM h EXCEPT ALL SELECT * FROM s) UNION ALL SELECT DISTINCT 'held_out_changed', image_id FROM (SELECT * FROM s EXCEPT ALL SELECT * FROM h)
UNION ALL SELECT DISTINCT 'id_leaks', image_id FROM t WHERE image_id IN (SELECT image_id FROM b) UNION ALL SELECT DISTINCT 'file_leaks', sha256 FROM t WHERE sha256 IN (SELECT sha256 FROM b)""")
def confirmation_violations(spark, sf_dir):
    n, at = _normals(spark, sf_dir), lambda k: F.col("doc_id") % k == 0
    changed = F.when(at(51), F.sha2(F.concat(F.lit("changed"), F.col("doc_id").cast("string")), 256)).otherwise(F.col("sha256"))
    t = n.where(at(3) | (F.col("doc_id") % 77 == 1)).select("image_id", changed.alias("sha256"), F.when(at(4), "anomaly").otherwise("normal").alias("label"))
    return manifests.confirmation_violations(t, n)


def _routes(spark, sf_dir):
    """Routes as a CSV with a declared schema, written and read."""
    path = f"{shared_dir(spark)}/veldspar-{uuid.uuid4().hex}"
    m = _manifest(spark, sf_dir)
    files.write_csv(m.select("object", "official_split", "label", F.col("image_path").alias("image"), F.col("mask_path").alias("mask")), path)
    return files.read_csv(spark, path, "object string, official_split string, label string, image string, mask string", blank_as_null=False)


@query("S2 F15", _M + """ SELECT object, official_split, label, image_path AS image FROM f WHERE object = 'src2' AND label = 'normal' AND regexp_full_match(image_path, 'src2/Data/Images/Normal/[^/]*\\.JPG')""")
def route_scan(spark, sf_dir):
    return manifests.routes(_routes(spark, sf_dir), "src2", "normal").select("object", "official_split", "label", "image")


@query("S3 F15", _M + """ SELECT 'label_known' AS rule, image_path AS id FROM f WHERE label = 'odd' UNION ALL
SELECT 'path_fits_label', image_path FROM f WHERE NOT regexp_full_match(image_path, object || '/Data/Images/' || CASE WHEN label = 'anomaly' THEN 'Anomaly' ELSE 'Normal' END || '/[^/]*\\.JPG') UNION ALL
SELECT 'mask_fits_label', image_path FROM f WHERE CASE WHEN label = 'anomaly' THEN mask_path = '' ELSE mask_path <> '' END UNION ALL SELECT 'unique_image', image_path FROM f GROUP BY image_path HAVING count(*) > 1""")
def route_violations(spark, sf_dir):
    return manifests.route_violations(_routes(spark, sf_dir))


@query("F11", """WITH t AS (SELECT event_id, CAST(user_id % 9 AS DOUBLE) / 2 AS r, CAST(event_id % 9 AS DOUBLE) AS c, event_id % 700 AS vec_id FROM events)
SELECT 'r_in_grid' AS rule, CAST(event_id AS VARCHAR) AS id FROM t WHERE r <> floor(r) UNION ALL SELECT 'c_in_grid', CAST(event_id AS VARCHAR) FROM t WHERE c >= 8
UNION ALL SELECT 'reference_known', CAST(event_id AS VARCHAR) FROM t WHERE vec_id NOT IN (SELECT vec_id FROM embeddings)""")
def trace_violations(spark, sf_dir):
    t = files.read_table(spark, sf_dir, "events").select("event_id", ((F.col("user_id") % 9).cast("double") / 2).alias("r"), (F.col("event_id") % 9).cast("double").alias("c"), (F.col("event_id") % 700).alias("vec_id"))
    return manifests.coordinate_violations(t, files.read_table(spark, sf_dir, "embeddings"), "event_id", {"r": 8, "c": 8}, ["vec_id"])


@query("F9 F10", """WITH g AS (SELECT count(*) AS rows, count(*) FILTER (value < 50) AS log_value, count(*) FILTER (event_type IN ('error', 'click') AND event_type <> 'error') AS label FROM events)
SELECT 'log_value' AS "column", rows, log_value AS bad FROM g UNION ALL SELECT 'label', rows, label FROM g""")
def guard_counts(spark, sf_dir):
    """Numbers that are null, NaN or infinite, and labels that aren't 0 or 1."""
    e = files.read_table(spark, sf_dir, "events")
    x = F.when(F.col("value") < 10, F.lit(None).cast("double")).when(F.col("value") < 30, F.lit(float("nan"))).when(F.col("value") < 50, F.lit(float("-inf"))).otherwise(F.col("value"))
    return manifests.guard_counts(e.select(x.alias("log_value"), F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "click", 2).otherwise(0).alias("label")), ["log_value"], ["label"])


#: Which region some nations are to have; one of them is wrong, and one isn't there.
_SETTINGS = {"NATION_3": "3", "NATION_7": "2", "NATION_8": "9", "ATLANTIS": "1"}


@query("F8", """SELECT x.key, expected, CAST(n_regionkey AS VARCHAR) AS found FROM (VALUES ('NATION_3', '3'), ('NATION_7', '2'), ('NATION_8', '9'), ('ATLANTIS', '1')) x(key, expected) LEFT JOIN nation ON n_name = x.key
WHERE n_regionkey IS NULL OR expected <> CAST(n_regionkey AS VARCHAR)""")
def setting_violations(spark, sf_dir):
    """Settings that a table holds, against fixed ones."""
    held = files.read_table(spark, sf_dir, "nation").select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value"))
    return manifests.setting_violations(held, _SETTINGS)


@query("F14", """SELECT 'orders' AS source, round(sum(o_totalprice), 2) AS total FROM orders UNION ALL SELECT 'lineitem', round(sum(l_extendedprice), 2) FROM lineitem UNION ALL SELECT 'events', round(sum(value), 2) FROM events""")
def coalesced_slots(spark, sf_dir):
    """One measure that each table has under a name of its own."""
    out = None
    for name in ("orders", "lineitem", "events"):
        t = files.read_table(spark, sf_dir, name)
        row = t.select(manifests.first_existing(t, ["value", "o_totalprice", "l_extendedprice"]).cast("double").alias("v")).agg(F.round(F.sum("v"), 2).alias("total")).select(F.lit(name).alias("source"), "total")
        out = row if out is None else out.unionByName(row)
    return out


@query("J2 J4", """WITH s AS (SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY o_custkey) SELECT c_custkey, c_name, n_orders, spent FROM customer LEFT JOIN s ON o_custkey = c_custkey""")
def one_to_one_join(spark, sf_dir):
    c = files.read_table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    s = files.read_table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("spent"), F.lit("x").alias("c_name"))
    return governance.one_to_one(c, s, ["c_custkey"])


@query("J3", """WITH s AS (SELECT l_returnflag, l_linestatus, count(*) AS lines FROM lineitem GROUP BY ALL) SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, lines FROM lineitem JOIN s USING (l_returnflag, l_linestatus)""")
def two_key_lookup(spark, sf_dir):
    rows = files.read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    s = rows.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("lines"))
    return governance.unique_lookup(rows, s, ["l_returnflag", "l_linestatus"]).select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "lines")


@query("O4 O5", """SELECT name, n, name = 'nation' AS changed FROM (SELECT 'region' AS name, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'part', count(*) FROM part)""")
def frozen_identities(spark, sf_dir):
    """Freezes what a run depends on, then tells which tables differ from it; one is changed in between."""
    tables = {n: files.read_table(spark, sf_dir, n) for n in ("region", "nation", "part")}
    path = f"{shared_dir(spark)}/veldspar-{uuid.uuid4().hex}.json"
    governance.freeze(spark, path, tables, {"seed": 42})
    now = tables | {"nation": tables["nation"].withColumn("n_name", F.lower("n_name"))}
    changed = governance.changed_tables(spark, path, now, {"seed": 42})
    rows = [(n, t.count(), n in changed) for n, t in now.items()]
    return spark.createDataFrame(rows, "name string, n long, changed boolean")


@query("K3 K4", """SELECT attempt, outcome, customers FROM (VALUES (1, 'written'), (2, 'kept'), (3, 'refused'), (4, 'refused'), (5, 'refused')) t(attempt, outcome), (SELECT count(*) AS customers FROM customer)""")
def immutable_sinks(spark, sf_dir):
    """A table's figures written, written again with equal and with other content, as a new file, and with a number that JSON
    lacks; and what is read back each time."""
    path = f"{shared_dir(spark)}/veldspar-{uuid.uuid4().hex}.json"
    held = {r["c_mktsegment"]: r["n"] for r in files.read_table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n")).collect()}
    out = []
    for attempt, (write, value) in enumerate(((files.write_once, held), (files.write_same, held), (files.write_same, held | {"more": 1}), (files.write_once, held), (files.write_same, held | {"more": float("nan")})), 1):
        try:
            write(spark, path, value)
            outcome = "written" if attempt == 1 else "kept"
        except (FileExistsError, ValueError):
            outcome = "refused"
        out.append((attempt, outcome, sum(json.loads(files.read_text(spark, path)).values())))
    files.delete(spark, path)
    return spark.createDataFrame(out, "attempt int, outcome string, customers long")


def _months(spark, sf_dir):
    o = files.read_table(spark, sf_dir, "orders")
    cents = F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")) * 100).cast("long")
    return o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), cents.alias("cents"))


@query("K2 K4 O6", """SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, CAST(round(sum(CAST(o_totalprice AS DECIMAL(18, 2))) * 100) AS BIGINT) AS cents, 'refused,written,kept,refused' AS outcomes FROM orders GROUP BY 1""")
def committed_months(spark, sf_dir):
    """A table that is written once: first before the one that it must follow, then rightly, again with equal rows in another
    order, and with other rows. What is there at the end are the first writer's rows."""
    base, rows, outcomes = f"{shared_dir(spark)}/veldspar-{uuid.uuid4().hex}", _months(spark, sf_dir), []
    for step, df in enumerate((rows, rows, rows.orderBy(F.desc("month")), rows.where("n > 1").withColumn("n", F.col("n") + 1))):
        if step == 1:
            governance.commit_once(files.read_table(spark, sf_dir, "region"), f"{base}/first")
        try:
            outcomes.append(governance.commit_once(df, f"{base}/months", after=f"{base}/first"))
        except (FileExistsError, RuntimeError):
            outcomes.append("refused")
    out = stored(governance.committed(spark, f"{base}/months").withColumn("outcomes", F.lit(",".join(outcomes))))
    files.delete(spark, base)
    return out


@query("O6", """SELECT step, taken, nations FROM (VALUES (1, 'secondary refused'), (2, 'primary'), (3, 'primary refused'), (4, 'secondary')) t(step, taken), (SELECT count(*) AS nations FROM nation)""")
def unseal_order(spark, sf_dir):
    """Steps that may be taken once, in order, each with a table that is open once it is taken; what is refused says so."""
    base = f"{shared_dir(spark)}/veldspar-{uuid.uuid4().hex}"
    out, n = [], files.read_table(spark, sf_dir, "nation").count()
    for step, (name, after) in enumerate((("secondary", "primary"), ("primary", None), ("primary", None), ("secondary", "primary")), 1):
        try:
            governance.claim(spark, f"{base}-{name}", f"{base}-{after}" if after else None)
            out.append((step, name, n))
        except (FileExistsError, RuntimeError):
            out.append((step, f"{name} refused", n))
    for name in ("primary", "secondary"):
        files.delete(spark, f"{base}-{name}")
    return spark.createDataFrame(out, "step int, taken string, nations long")


@query("O4 O5 O9", """WITH a AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderkey % 16 AS part FROM orders), b AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 160 = 3 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 16 = 5 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, part FROM a WHERE o_orderkey % 320 <> 7
  UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice, part FROM a WHERE o_orderkey % 320 = 9),
c AS (SELECT * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT ALL SELECT * FROM a))
SELECT DISTINCT 'orders[' || part || ']' AS changed FROM c""")
def changed_orders(spark, sf_dir):
    """Which partitions of a frozen table have changed: rows with other values, rows gone and rows that are there twice."""
    a = files.read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    key = F.col("o_orderkey")
    b = a.where(key % 320 != 7).select(key, F.when(key % 160 == 3, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), F.when(key % 16 == 5, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice")).union(a.where(key % 320 == 9))
    path, by = f"{shared_dir(spark)}/veldspar-{uuid.uuid4().hex}.json", {"orders": key % 16}
    governance.freeze(spark, path, {"orders": a}, {}, by)
    changed = governance.changed_tables(spark, path, {"orders": b}, {}, by)
    files.delete(spark, path)
    return spark.createDataFrame([(c,) for c in changed], "changed string")


_LINKS = """p AS (SELECT page_id, lower(regexp_extract(html, '<title>([^ <]+)', 1)) AS word, list_distinct(list_transform(regexp_extract_all(html, 'href="/([^"]+)"', 1), lambda w: lower(w))) AS links FROM pages),
e AS (SELECT DISTINCT s.page_id AS source, t.page_id AS target FROM (SELECT page_id, unnest(links) AS word FROM p) s JOIN p t ON t.word = s.word AND t.word <> '' WHERE s.page_id <> t.page_id)"""


@query("O12", f"""WITH RECURSIVE {_LINKS}, c AS (SELECT page_id AS node, 0 AS hops FROM pages WHERE page_id % 40 = 1 UNION SELECT target, hops + 1 FROM c JOIN e ON source = node WHERE hops < 40)
SELECT node, min(hops) AS hops FROM c GROUP BY node""")
def linked_pages(spark, sf_dir):
    """Closure over links with circles: a page links to those whose title begins with the word of a link; what is reached from
    some pages, by how few links."""
    pages = files.read_table(spark, sf_dir, "pages")
    word = F.lower(F.regexp_extract("html", "<title>([^ <]+)", 1))
    found = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]+)"'), F.lit(1))).alias("word")).select("page_id", F.lower("word").alias("word")).distinct()
    # pages of one word are one node between, so a word's pages are never paired with the pages that link to it
    out = found.select(F.concat(F.lit("p"), "page_id").alias("source"), F.concat(F.lit("w"), "word").alias("target"))
    into = pages.select(F.concat(F.lit("w"), word).alias("source"), F.concat(F.lit("p"), "page_id").alias("target")).where(F.col("source") != "w")
    seeds = pages.where("page_id % 40 = 1").select(F.concat(F.lit("p"), "page_id").alias("node"))
    reached = links.reachable(out.union(into), seeds).where(F.col("node").startswith("p"))
    return reached.select(F.substring("node", 2, 30).cast("long").alias("node"), F.expr("hops div 2").cast("int").alias("hops"))


@query("O7", """SELECT phase, round(quantile_cont(v, 0.5), 6) AS median_s, quantile_cont(v, 0.5) <= 60 AS within FROM (SELECT event_type AS phase, value AS v FROM events) GROUP BY phase""")
def resource_gate(spark, sf_dir):
    """Medians of a phase's latencies against a limit."""
    return six(governance.median_within(predictions(spark, sf_dir).select(F.col("kind").alias("phase"), F.col("score").alias("v")), ["phase"], "v", 60.0), "median_s")


@query("O10")
def environment(spark, sf_dir):
    """What a run was made with: versions of the interpreter and libraries, and the settings that shape its plans."""
    rows = [("python", platform.python_version()), ("spark", spark.version), *[(n, version(n)) for n in ("numpy", "pandas", "pyarrow")]]
    rows += [(f"rows of {n}", str(files.read_table(spark, sf_dir, n).count())) for n in ("documents", "embeddings", "orders", "events")]
    rows += [(k, spark.conf.get(k)) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.session.timeZone")]
    return spark.createDataFrame(rows, "name string, value string")
