"""Validation, identities, splits, leakage, near-duplicates, invariance and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import identity, packed_bits, rounded
from ..operators import governance
from ..sources.files import read_table
from .base import query


@query("A2 O1", "SELECT sha256(text) AS sha256, count(*) AS copies, count(DISTINCT source) AS sources, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicate_groups(spark, sf_dir):
    g = read_table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count("*").alias("copies"), F.countDistinct("source").alias("sources"), F.min("doc_id").alias("first_id"))
    return g.where("copies > 1")


@query("O1", """SELECT page_id, substr(sha256(url || '|' || html), 1, 24) AS image_id, length(html) AS width, CASE WHEN length(html) < 1200 THEN 'too small' WHEN html LIKE '%<script%' THEN 'scripted' END AS reject FROM pages""")
def manifest_build(spark, sf_dir):
    p = read_table(spark, sf_dir, "pages")
    reject = F.when(F.length("html") < 1200, "too small").when(F.contains("html", F.lit("<script")), "scripted")
    return p.select("page_id", identity(F.col("url"), F.col("html")).alias("image_id"), F.length("html").cast("long").alias("width"), reject.alias("reject"))


@query("O2", """WITH g AS (SELECT DISTINCT sha256(text) AS grp FROM documents), r AS (SELECT grp, row_number() OVER (ORDER BY sha256('42|' || grp)) AS i, count(*) OVER () AS n FROM g), s AS (SELECT grp, CASE WHEN i <= ceil(0.2 * n) THEN 'calibration' ELSE 'fit' END AS split FROM r)
SELECT doc_id, split FROM documents JOIN s ON sha256(text) = grp""")
def hash_group_split(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("grp"))
    return d.join(governance.hash_split(d, "grp"), "grp").select("doc_id", "split")


@query("J10 J11 O3 R3", "SELECT DISTINCT sha256(text) AS sha FROM documents WHERE lang = 'en' AND source < 'src5' INTERSECT SELECT sha256(text) FROM documents WHERE source >= 'src5'")
def leakage_check(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").withColumn("sha", F.sha2("text", 256))
    return governance.shared_keys(d.where("lang = 'en' AND source < 'src5'"), d.where("source >= 'src5'"), "sha")


_CODES = """c AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS b FROM embeddings), k AS (SELECT vec_id, list_reduce(list_prepend(CAST(0 AS HUGEINT), list_transform(b[1:64], lambda f: CASE WHEN f THEN CAST(1 AS HUGEINT) ELSE 0 END)), lambda a, f: a * 2 + f) AS code FROM c),
t AS (SELECT v.vec_id, xor(k.code, CAST(CASE v.vec_id % 4 WHEN 1 THEN 1 WHEN 2 THEN 5 ELSE 0 END AS HUGEINT)) AS code FROM k v JOIN k ON k.vec_id = v.vec_id - v.vec_id % 4)"""


_NEAR = "WITH " + _CODES + """, g AS (SELECT code, min(vec_id) AS i, count(*) AS m FROM t GROUP BY code),
p AS (SELECT a.i AS a, b.i AS b, CAST(bit_count(xor(a.code, b.code)) AS INTEGER) AS distance, a.m AS copies_a, b.m AS copies_b FROM g a JOIN g b ON a.i < b.i)"""


def _codes(spark, sf_dir):
    """The signs of a vector's components as a 64-bit code. Four vectors in a row take the first one's code, with no, one or
    two bits turned, so that there is something to find."""
    v = read_table(spark, sf_dir, "embeddings").select("vec_id", packed_bits(F.transform("embedding", lambda x: x > 0)).alias("code"))
    at = F.col("vec_id") % 4
    first = v.select(F.col("vec_id").alias("of"), "code")
    turned = F.when(at == 1, 1).when(at == 2, 5).otherwise(0).cast("long")
    return v.select("vec_id").join(first, F.col("vec_id") - at == F.col("of")).select("vec_id", F.col("code").bitwiseXOR(turned).alias("code"))


@query("J12", _NEAR + " SELECT a, b, distance, copies_a, copies_b FROM p WHERE distance <= 2")
def hamming_near_dup(spark, sf_dir):
    return governance.near_pairs(_codes(spark, sf_dir), "vec_id", "code", 2, 4)


@query("J12", "WITH " + _CODES + " SELECT vec_id AS id, min(vec_id) OVER (PARTITION BY code) AS representative FROM t")
def hamming_members(spark, sf_dir):
    return governance.code_members(_codes(spark, sf_dir), "vec_id", "code")


@query("J13", _NEAR + """, r AS (SELECT a, b, distance, row_number() OVER (ORDER BY distance, a, b) AS n FROM p WHERE distance <= 2)
SELECT a, b, distance, x.label AS label_a, y.label AS label_b, round(list_aggregate(list_transform(list_zip(x.embedding, y.embedding), lambda z: abs(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE))), 'avg'), 6) AS mean_difference
FROM r JOIN embeddings x ON x.vec_id = a JOIN embeddings y ON y.vec_id = b WHERE n <= 20""")
def near_duplicate_review(spark, sf_dir):
    """The 20 closest pairs, with both sides' labels and the mean difference of their values."""
    pairs = governance.near_pairs(_codes(spark, sf_dir), "vec_id", "code", 2, 4).select("a", "b", "distance")
    met = governance.closest_pairs(pairs, read_table(spark, sf_dir, "embeddings"), "vec_id", ["label", "embedding"])
    apart = F.zip_with("embedding_a", "embedding_b", lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    mean = F.aggregate(apart, F.lit(0.0), lambda s, x: s + x) / F.size("embedding_a")
    return met.select("a", "b", "distance", "label_a", "label_b", rounded(mean).alias("mean_difference"))


@query("J1 J5", """SELECT o_orderkey, c_name, n_name, coalesce(r_name, 'not_labeled') AS region, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey AND r_name LIKE 'A%'""")
def validated_lookup(spark, sf_dir):
    t = lambda n: read_table(spark, sf_dir, n)
    o = t("orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    a = governance.unique_lookup(o, t("customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("n_nationkey")), ["c_custkey"])
    b = governance.unique_lookup(a, t("nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey")), ["n_nationkey"])
    c = governance.unique_lookup(b, t("region").where(F.col("r_name").startswith("A")), ["r_regionkey"], "left", must_match=False)
    return c.select("o_orderkey", "c_name", "n_name", F.coalesce("r_name", F.lit("not_labeled")).alias("region"), "o_totalprice")


@query("O9 R4", """WITH a AS (SELECT doc_id, lang, n_chars FROM documents), b AS (SELECT doc_id, CASE WHEN doc_id % 100 = 3 THEN 'xx' ELSE lang END AS lang, n_chars FROM documents)
SELECT *, 'before' AS only_in FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'after' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def no_op_invariance(spark, sf_dir):
    a = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return governance.changed_rows(a, a.withColumn("lang", F.when(F.col("doc_id") % 100 == 3, "xx").otherwise(F.col("lang"))))


@query("R1 R2 R3", """WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R')
SELECT 'union' AS op, count(*) AS n FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)""")
def set_operations(spark, sf_dir):
    l = read_table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), "l_returnflag")
    a, b = l.where("l_returnflag = 'A'").select("k"), l.where("l_returnflag = 'R'").select("k")
    each = {"union": a.unionByName(b).distinct(), "intersect": a.intersect(b), "except": a.exceptAll(b).distinct().join(b, "k", "left_anti")}
    out = None
    for name, rows in each.items():
        n = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query("F4 S4 S5", """SELECT p_brand, CAST(json_extract_string('{"sizes": {"small": 10, "large": 40}}', '$.sizes.small') AS INTEGER) AS small_limit, count(*) FILTER (p_size <= 10) AS n_small, count(*) AS n FROM part WHERE p_type = 'ECONOMY' GROUP BY p_brand""")
def protocol_values(spark, sf_dir):
    limit = F.get_json_object(F.lit('{"sizes": {"small": 10, "large": 40}}'), "$.sizes.small").cast("int")
    p = read_table(spark, sf_dir, "part").where("p_type = 'ECONOMY'")
    return p.groupBy("p_brand").agg(F.max(limit).alias("small_limit"), F.count_if(F.col("p_size") <= limit).alias("n_small"), F.count("*").alias("n"))
