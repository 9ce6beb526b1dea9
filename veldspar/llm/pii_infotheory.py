"""Personal data: base patterns, and information-theoretic sanitisation of the terms that reveal them.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers (``KINDS``). Each distinct value is a
protected entity. All terms that stand outside base spans in the documents that hold an entity are its co-occurring
terms; the corpus tells how strongly a term reveals the entity: the pointwise mutual information of term and entity as a
share of the entity's self-information,

    disclosure = log(P(e|t) / P(e)) / log(1 / P(e)),   P(e) = n(e) / N
    P(e|t) = (n(t, e) + PRIOR * P(e)) / (n(t) + PRIOR)

with counts of documents. It is near 1 if the term occurs only with the entity, and about 0 if it tells nothing; the
prior lowers it where few documents speak for it. ``findings`` leaves out no pair for its count. ``redact`` changes texts,
and that a rare word stands in the one document of an entity says nothing of either, so there a pair also needs support:
``SUPPORT`` documents that hold both, or a term that is tied to the entity, as a part of the entity's own value (a name
in an e-mail address). Revealing terms are sanitised wherever they stand in the
entity's documents: from ``GENERALISE`` on they are generalised to their class, which is the kind of entity that they
reveal most and whether they are written as names are, and from ``REMOVE`` on removed. Documents without base spans hold
no entity, and are never changed.

Entities that the same documents hold co-occur alike with every term, so they are one group: a list of addresses that
stand nowhere else is one, however long. A pair can reach ``GENERALISE`` only if n(t) is at most ``_most(n(e), N)``, as n(t, e) <= n(e). Pairs
beyond it are not formed, which changes no result.

All of it is DataFrame functions. Patterns start only at the end of the last match or where a run of their first
class begins, and repeat possessively, which matches the same strings in linear time and constant stack depth. Terms
are counted over the corpus, summed within tasks first, and met by the terms of documents with entities. The documents
are read three times, so they must be the same each time; only those with base spans are written.

Defined results: null text is empty and has no spans; repeated rows count as documents each; a null doc_id takes part;
an empty table gives an empty result; ``redact`` keeps extra columns, whatever their names and types.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_TEXTS, durable, in_scope, scope, small_side, table, text_or_empty

KINDS = ["email", "ip", "card", "phone", "term"]
PLACEHOLDERS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
PRIOR, GENERALISE, REMOVE, SUPPORT = 0.5, 0.85, 0.97, 2
TERM = r"\p{L}{3,}+"

_START = r"(?:\G|(?<![{0}]))"
PATTERNS = {
    "email": _START.format("A-Za-z0-9._%+-") + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": _START.format("0-9") + r"[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
HINTS = {"email": "@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
#: Elements that a fold over an array gathers at once.
RUN = 256
SPAN = "struct<start:bigint,kind:int,end:bigint,value:string>"
TERM_SPANS = "array<struct<start:bigint,end:bigint,disclosure:double,kind:int>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


CHECKS = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
    "card": lambda v: F.length(_digits(v)).between(14, 19) & _luhn(v),
    "phone": lambda v: F.length(_digits(v)).between(10, 15),
}


def _let(value: Column, use) -> Column:
    """``use(value)``, where the value is made once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _sums_before(sizes: Column, at: Column) -> Column:
    zero = F.struct(at.cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
    add = lambda s, x: F.struct((s["at"] + x).cast("long").alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
    return F.aggregate(sizes, zero, add, lambda s: s["out"])


def starts(sizes: Column) -> Column:
    """``at``, where elements of some sizes begin that lie end to end: in runs of RUN, as a fold copies what it has."""
    runs = F.transform(F.sequence(F.lit(0), F.floor(F.size(sizes) / RUN).cast("int")), lambda i: F.slice(sizes, i * RUN + 1, F.lit(RUN)))

    def placed(r: Column) -> Column:
        begin = _sums_before(F.transform(r, lambda run: F.aggregate(run, F.lit(0).cast("long"), lambda s, x: s + x)), F.lit(0))
        return F.flatten(F.zip_with(r, begin, lambda run, at: _sums_before(run, at)))

    return _let(runs, placed)


def _matches(text: Column, pattern: str, use) -> Column:
    """``use(match, its start)`` of all matches: the lengths of what lies between matches and of matches add up to their
    places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = _let(found, lambda f: F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(f)).alias("gap"), f.alias("value")))

    def made(p: Column) -> Column:
        at = starts(F.transform(p, lambda x: (F.length(x["gap"]) + F.length(x["value"])).cast("long")))
        return F.zip_with(p, at, lambda x, a: use(x["value"], (a + F.length(x["gap"])).cast("long")))

    return _let(pairs, made)


def located(text: Column, pattern: str, kind: int) -> Column:
    """Spans of all matches."""
    return _matches(text, pattern, lambda v, a: F.struct(a.alias("start"), F.lit(kind).alias("kind"), (a + F.length(v)).cast("long").alias("end"), v.alias("value")))


def _passes(kind: str):
    return lambda s: CHECKS[kind](s["value"])


def base_spans(text: Column) -> Column:
    """All base spans of a text that isn't null, by start, then kind."""
    none = F.array().cast(f"array<{SPAN}>")
    each = []
    for i, kind in enumerate(KINDS[:4]):
        each.append(F.when(text.rlike(HINTS[kind]), F.filter(located(text, PATTERNS[kind], i), _passes(kind))).otherwise(none))
    return F.array_sort(F.concat(*each))


def _entity(kind: Column, value: Column) -> Column:
    return F.concat_ws(":", kind, F.when(kind == 0, F.lower(value)).when(kind == 1, value).otherwise(_digits(value)))


def _outside() -> Column:
    """The text of a row of ``sanitised`` with blanks in place of its base spans."""

    def add(state: Column, s: Column) -> Column:
        gap = F.substring(F.col("p_text"), (state["at"] + 1).cast("int"), F.greatest(F.lit(0), s["start"] - state["at"]).cast("int"))
        blank = F.repeat(F.lit(" "), F.greatest(F.lit(0), s["end"] - F.greatest(state["at"], s["start"])).cast("int"))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["parts"], F.array(gap, blank)).alias("parts"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))
    rest = lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(F.col("p_text"), (s["at"] + 1).cast("int"), F.length("p_text")))
    return F.when(F.size("p_base") > 0, F.aggregate("p_base", zero, add, rest)).otherwise(F.col("p_text"))


def _terms() -> Column:
    """The distinct terms outside base spans."""
    return F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all(_outside(), F.lit(TERM), F.lit(0))), F.lower))


def _most(n_e: Column, total: float) -> Column:
    """No term of more documents can reveal an entity of n_e documents, as log(P(e|t)) would be too low even with all of them."""
    return n_e * (1 + PRIOR / total) * F.pow(F.lit(total) / n_e, F.lit(1 - GENERALISE)) * (1 + 1e-9) - PRIOR


def _tied(kind: Column, value: Column) -> Column:
    """Terms that are parts of an entity's value."""
    return F.when(kind == 0, F.array_distinct(F.regexp_extract_all(F.lower(value), F.lit(TERM), F.lit(0)))).otherwise(F.array().cast("array<string>"))


def revealing_terms(found: DataFrame, clean: DataFrame, total: float, support: int = SUPPORT) -> DataFrame:
    """(p_row, term, disclosure, kind) of the terms that reveal an entity of the row, at their highest disclosure and of what
    kind; of the rows with base spans and of all others, ``total`` together."""
    entities = F.array_distinct(F.transform("p_base", lambda s: F.struct(_entity(s["kind"], s["value"]).alias("entity"), s["kind"].alias("kind"), _tied(s["kind"], s["value"]).alias("parts"))))
    held = durable(found.select("p_row", F.explode(entities).alias("e")).select("p_row", "e.*"))
    # two sums of the rows' hashes stand for the set of rows
    mark = [F.sum(F.xxhash64("p_row", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in (1, 2)]
    sizes = durable(held.groupBy("entity").agg(F.count("*").alias("n_e"), *mark).where(F.col("n_e") < total))
    n_sizes, widest = sizes.agg(F.count("*"), F.max("n_e")).first()
    held = durable(held.join(small_side(sizes, n_sizes, BROADCAST_TEXTS), "entity"))
    words = found.select(F.lit(True).alias("near"), F.explode(_terms()).alias("term")).union(clean.select(F.lit(False).alias("near"), F.explode(_terms()).alias("term")))
    seen = words.groupBy("term").agg(F.count("*").alias("n_t"), F.max("near").alias("near"))
    rare = durable(seen.where(F.col("near") & (F.col("n_t") <= _most(F.lit(widest or 1), total))).select("term", "n_t"))
    terms = durable(found.select("p_row", F.explode(_terms()).alias("term")).join(small_side(rare, rare.count(), BROADCAST_TEXTS), "term"))
    possible = F.col("n_t") <= _most(F.col("n_e"), total)
    # groups of entities that enough documents hold, with the terms of enough documents
    group = F.concat_ws(":", "n_e", "s1", "s2")
    groups = held.where(F.col("n_e") >= support).groupBy("p_row", group.alias("who"), "n_e").agg(F.min("kind").alias("kind"))
    shared = terms.where(F.col("n_t") >= support).join(groups, "p_row").where(possible).select("p_row", "who", "term", "n_t", "n_e", "kind")
    own = held.where(F.size("parts") > 0).select("p_row", F.col("entity").alias("who"), "n_e", "kind", F.explode("parts").alias("term"))
    tied = own.join(terms, ["p_row", "term"]).where(possible).select("p_row", F.concat(F.lit("="), "who").alias("who"), "term", "n_t", "n_e", "kind")
    pairs = durable(shared.withColumn("tied", F.lit(False)).union(tied.withColumn("tied", F.lit(True))))
    together = pairs.groupBy("who", "term").agg(F.count("*").alias("n_et"), F.first("n_t").alias("n_t"), F.first("n_e").alias("n_e"), F.first("tied").alias("tied"))
    given = (F.col("n_et") + PRIOR * F.col("n_e") / F.lit(total)) / (F.col("n_t") + PRIOR)
    scored = together.where(F.col("tied") | (F.col("n_et") >= support)).select("who", "term", (1 + F.log(given) / F.log(F.lit(total) / F.col("n_e"))).alias("disclosure"))
    strong = durable(scored.where(F.col("disclosure") >= GENERALISE))
    chosen = pairs.select("p_row", "who", "term", "kind").join(small_side(strong, strong.count(), BROADCAST_TEXTS), ["who", "term"])
    most = chosen.groupBy("p_row", "term").agg(F.max(F.struct("disclosure", (-F.col("kind")).alias("k"))).alias("m"))
    return most.select("p_row", "term", F.col("m.disclosure").alias("disclosure"), (-F.col("m.k")).cast("int").alias("kind"))


def _occurrences() -> Column:
    """Spans of all occurrences outside base spans of the terms in the map p_strong."""
    def made(v: Column, a: Column) -> Column:
        told = F.try_element_at(F.col("p_strong"), F.lower(v))
        return F.struct(a.alias("start"), (a + F.length(v)).cast("long").alias("end"), told["disclosure"].alias("disclosure"), told["kind"].alias("kind"))

    return F.filter(_matches(_outside(), TERM, made), lambda s: s["disclosure"].isNotNull())


def sanitised(docs: DataFrame, support: int = SUPPORT) -> DataFrame:
    """p_doc (a row of ``docs``), p_row, p_text (never null), p_base (base spans) and p_terms (spans of revealing terms with
    their disclosure, and the kind of entity that they reveal)."""
    row, none = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("p_doc"), F.array().cast(f"array<{SPAN}>")
    base, text = base_spans(text_or_empty()), F.coalesce(F.col("p_doc.text"), F.lit("")).alias("p_text")
    # texts without base spans are read again where they are needed, not written
    clean = docs.where(F.size(base) == 0).select(row, none.alias("p_base"), F.lit(None).cast("long").alias("p_row")).withColumn("p_text", text)
    with scope(docs.sparkSession):
        found = durable(docs.select(row, base.alias("p_base")).where(F.size("p_base") > 0).withColumn("p_row", F.monotonically_increasing_id()), keep=True).withColumn("p_text", text)
        terms = revealing_terms(found, clean, float(max(1, docs.count())), support)
        strong = durable(terms.groupBy("p_row").agg(F.map_from_entries(F.collect_list(F.struct("term", F.struct("disclosure", "kind")))).alias("p_strong")), keep=True)
    none = F.array().cast(TERM_SPANS)
    spans = F.when(F.col("p_strong").isNotNull(), _occurrences()).otherwise(none)
    return clean.withColumn("p_terms", none).unionByName(found.join(strong, "p_row", "left").withColumn("p_terms", spans).drop("p_strong"))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def all_spans() -> Column:
    """Base spans and terms of a row of ``sanitised`` by start, then kind."""
    terms = F.transform("p_terms", lambda t: F.struct(t["start"].alias("start"), F.lit(4).alias("kind"), t["end"].alias("end")))
    return F.array_sort(F.concat(F.transform("p_base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))), terms))


def redacted() -> Column:
    """The text of a row of ``sanitised`` with base spans and generalised terms replaced by placeholders and others removed.
    Where spans overlap, the first one's placeholder stands for all that they cover together."""
    place = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS[:4]) for x in (i, PLACEHOLDERS[k])])
    base = F.transform("p_base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), place[s["kind"]].alias("by")))

    def general(t: Column) -> Column:
        """A term's class: what it reveals, and whether it begins as a name does."""
        written = F.substring(F.col("p_text"), (t["start"] + 1).cast("int"), F.lit(1))
        return F.concat(F.regexp_replace(place[t["kind"]], "\\]", " "), F.when(written == F.lower(written), "TERM]").otherwise("NAME]"))

    terms = F.transform("p_terms", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.when(t["disclosure"] >= REMOVE, "").otherwise(general(t)).alias("by")))

    def add(state: Column, s: Column) -> Column:
        between = F.substring(F.col("p_text"), (state["at"] + 1).cast("int"), F.greatest(F.lit(0), s["start"] - state["at"]).cast("int"))
        out = F.concat(state["parts"], F.when(s["start"] >= state["at"], F.array(between, s["by"])).otherwise(F.array().cast("array<string>")))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), out.alias("parts"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))
    rest = lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(F.col("p_text"), (s["at"] + 1).cast("int"), F.length("p_text")))
    return F.aggregate(F.array_sort(F.concat(base, terms)), zero, add, rest)


def findings(docs: DataFrame) -> DataFrame:
    """Spans of base and of all revealing terms, however few documents hold them."""
    count = lambda i: F.size(F.filter("p_base", lambda s: s["kind"] == i)).cast("long").alias(f"n_{KINDS[i]}")
    return sanitised(docs.select("doc_id", "text"), 1).select(
        F.col("p_doc.doc_id").alias("doc_id"), *[count(i) for i in range(4)], F.sha2(_listed(F.col("p_base")), 256).alias("base_sha256"), _listed(all_spans()).alias("spans"),
        F.size("p_base").cast("long").alias("n_base"), F.size("p_terms").cast("long").alias("n_term"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with redacted texts, and n_chars (where there is such a column) as the new length; all columns stay."""
    new, has = F.when(F.size("p_base") > 0, redacted()).otherwise(F.col("p_text")), F.size("p_base") > 0
    own = {c: F.col("p_doc").getField(c).alias(c) for c in docs.columns}
    own["text"] = F.when(F.col("p_doc.text").isNotNull(), new).alias("text")
    if "n_chars" in own:
        own["n_chars"] = F.when(has, F.length(new).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("p_doc.n_chars")).alias("n_chars")
    return sanitised(docs).select(*own.values())


def op8_pii_infotheory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_scope(spark, lambda: findings(table(spark, sf_dir, "documents")))


def _sql_matches(name: str, source: str, pattern: str, columns: str, where: str = "TRUE") -> str:
    """Two tables: all matches of a pattern in the texts (r, t) of a table, and these with their starts."""
    return rf"""
{name}_all AS (
  SELECT r, {columns}, unnest(string_split_regex(t, '{pattern}')) AS gap, unnest(list_append(regexp_extract_all(t, '{pattern}'), NULL)) AS value, generate_subscripts(list_append(regexp_extract_all(t, '{pattern}'), NULL), 1) AS j
  FROM {source} WHERE {where}
), {name} AS (
  SELECT *, CAST(sum(length(gap)) OVER way + coalesce(sum(length(value)) OVER (way ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s
  FROM {name}_all WINDOW way AS (PARTITION BY r ORDER BY j) QUALIFY value IS NOT NULL
)"""


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
{_sql_matches("email", "d", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "0 AS i, 'email' AS kind", "contains(t, '@')")},
{_sql_matches("ip", "d", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "1 AS i, 'ip' AS kind")},
{_sql_matches("card", "d", r"[0-9](?:[\x20-]?[0-9])+", "2 AS i, 'card' AS kind")},
{_sql_matches("phone", "d", r"\+[0-9][\x20().0-9-]+[0-9]", "3 AS i, 'phone' AS kind", "contains(t, '+')")},
found AS (
  SELECT r, i, kind, s, s + length(value) AS e, value, regexp_replace(value, '[^0-9]', '', 'g') AS digits
  FROM (SELECT * FROM email UNION ALL SELECT * FROM ip UNION ALL SELECT * FROM card UNION ALL SELECT * FROM phone)
), base AS (
  SELECT * FROM found WHERE CASE i WHEN 0 THEN TRUE
    WHEN 1 THEN len(list_filter(string_split(value, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(ltrim(x, '0') AS INTEGER), 0) > 255)) = 0
    WHEN 2 THEN length(digits) BETWEEN 14 AND 19 AND CAST(list_sum(list_transform(range(1, length(digits) + 1), lambda p:
      CASE WHEN p % 2 = 1 THEN CAST(substr(reverse(digits), p, 1) AS INTEGER)
           WHEN CAST(substr(reverse(digits), p, 1) AS INTEGER) > 4 THEN 2 * CAST(substr(reverse(digits), p, 1) AS INTEGER) - 9 ELSE 2 * CAST(substr(reverse(digits), p, 1) AS INTEGER) END)) AS BIGINT) % 10 = 0
    ELSE length(digits) BETWEEN 10 AND 15 END
), spans AS (SELECT r, list(struct_pack(s := s, e := e)) AS held FROM base GROUP BY r),
outside AS (
  SELECT d.r, held IS NOT NULL AS near, CASE WHEN held IS NULL THEN t
    ELSE array_to_string(list_transform(range(1, length(t) + 1), lambda p: CASE WHEN len(list_filter(held, lambda h: p > h.s AND p <= h.e)) > 0 THEN ' ' ELSE substr(t, p, 1) END), '') END AS t
  FROM d LEFT JOIN spans USING (r)
), terms AS (SELECT DISTINCT r, term FROM (SELECT r, lower(unnest(regexp_extract_all(t, '\p{{L}}{{3,}}'))) AS term FROM outside)),
n_t AS (SELECT term, count(*) AS n_t FROM terms GROUP BY term),
total AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM d),
held AS (SELECT DISTINCT r, i || ':' || CASE i WHEN 0 THEN lower(value) WHEN 1 THEN value ELSE digits END AS entity FROM base),
n_e AS (SELECT entity, count(*) AS n_e FROM held GROUP BY entity),
pairs AS (SELECT r, entity, term FROM held JOIN terms USING (r)),
strong AS (
  SELECT entity, term FROM (SELECT entity, term, count(*) AS n_et FROM pairs GROUP BY entity, term) JOIN n_t USING (term) JOIN n_e USING (entity) CROSS JOIN total
  WHERE n_e < n AND 1 + ln((n_et + {PRIOR} * n_e / n) / (n_t + {PRIOR})) / ln(n / n_e) >= {GENERALISE}
), chosen AS (SELECT DISTINCT r, term FROM pairs JOIN strong USING (entity, term)),
near AS (SELECT r, t FROM outside WHERE near),
{_sql_matches("seen", "near", r"\p{L}{3,}", "4 AS i, 'term' AS kind")},
spanned AS (
  SELECT r, i, kind, s, e FROM base UNION ALL SELECT seen.r, i, kind, s, s + length(value) FROM seen JOIN chosen ON chosen.r = seen.r AND chosen.term = lower(value)
)
SELECT doc_id, count(*) FILTER (i = 0) AS n_email, count(*) FILTER (i = 1) AS n_ip, count(*) FILTER (i = 2) AS n_card, count(*) FILTER (i = 3) AS n_phone,
       sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, i) FILTER (i < 4), '')) AS base_sha256, coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, i), '') AS spans,
       count(*) FILTER (i < 4) AS n_base, count(*) FILTER (i = 4) AS n_term
FROM d LEFT JOIN spanned USING (r) GROUP BY d.r, doc_id
"""
