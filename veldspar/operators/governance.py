"""Data governance: validators, duplicate-safe splits, leakage, near-duplicate pairs, invariance, frozen identities."""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import hamming
from ..sources.files import create, delete, exists, read_text, write_once, write_parquet
from ..sources.scratch import stored
from .order import linear_quantiles, running

#: Codes that may share a key of bands before it is split, and keys that are broadcast (16 bytes each).
HOT, SMALL = 256, 1_000_000


def violations(df: DataFrame, id_col: str, rules: dict[str, Column], grouped: dict[str, tuple[list[str], Column]] | None = None) -> DataFrame:
    """(rule, id) of each row that breaks a row rule (a condition that must hold), and (rule, key) of each group that
    breaks a rule on groups (keys and a condition on aggregates that must hold)."""
    out = df.select(F.explode(F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))).alias("rule"), F.col(id_col).cast("string").alias("id"))
    for name, (keys, ok) in (grouped or {}).items():
        bad = df.groupBy(*keys).agg(ok.alias("_ok")).where(~F.coalesce(F.col("_ok"), F.lit(False)))
        out = out.unionByName(bad.select(F.lit(name).alias("rule"), F.concat_ws("|", *keys).alias("id")))
    return out


def require_empty(found: DataFrame, what: str) -> None:
    if rows := found.take(3):
        raise ValueError(f"{what}: {rows}")


def unique_lookup(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", must_match: bool = True) -> DataFrame:
    """A join whose right side must have unique keys and, if asked, a row for every left row."""
    require_empty(right.groupBy(*keys).count().where("count > 1"), "keys of the right side aren't unique")
    if must_match:
        require_empty(left.join(right, keys, "left_anti"), "keys without a row on the right side")
    return left.join(right, keys, how)


def hash_split(df: DataFrame, group: str, share: float = 0.2, seed: str = "42") -> DataFrame:
    """(group, split): the first ceil(share * groups) groups by SHA-256 of seed and group are calibration, the others fit.
    Rows of a group never part. The hash's order is dealt into ranges, so no task sorts all groups."""
    groups = df.select(F.col(group).alias("g")).where(F.col("g").isNotNull()).distinct()
    keyed = groups.withColumn("k", F.sha2(F.concat_ws("|", F.lit(seed), F.col("g")), 256)).withColumn("v", F.conv(F.substring("k", 1, 12), 16, 10).cast("double"))
    by_value = running(keyed.groupBy("v").agg(F.count("*").alias("n")), "v", ["n"])
    total = groups.agg(F.count("*").alias("total"))
    edge = F.ceil(F.lit(share) * F.col("total"))
    from pyspark.sql.window import Window

    place = F.col("cum_n") - F.col("n") + F.row_number().over(Window.partitionBy("v").orderBy("k"))
    met = keyed.join(by_value, "v").crossJoin(F.broadcast(total))
    return met.select(F.col("g").alias(group), F.when(place <= edge, "calibration").otherwise("fit").alias("split"))


def shared_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys on both sides: leakage where there should be none."""
    return a.select(key).distinct().join(b.select(key), key, "left_semi")


def code_members(df: DataFrame, id_col: str, code: str) -> DataFrame:
    """(id, representative): of rows with one code the least id stands for all."""
    rows = df.where(F.col(code).isNotNull()).select(F.col(id_col).alias("id"), F.col(code).alias("c"))
    least = rows.groupBy("c").agg(F.min("id").alias("representative"))
    return rows.join(least, "c").select("id", "representative")


def _packed(code: Column, bands: tuple[int, ...], width: int) -> Column:
    """Some bands of a code side by side."""
    part = lambda i: F.shiftrightunsigned(code, i * width).bitwiseAND(F.lit((1 << width) - 1))
    out = F.lit(0).cast("long")
    for i in bands:
        out = F.shiftleft(out, width).bitwiseOR(part(i))
    return out


def band_keys(df: DataFrame, code: str, most: int, bands: int, bits: int, prefix: str) -> DataFrame:
    """``df`` with a row for each choice of bands - most of the bands of a code of so many bits: the choice's number (``prefix``
    combo) and those bands (``prefix`` key). Codes that differ in at most ``most`` bits have one of these rows in common."""
    choices = list(itertools.combinations(range(bands), bands - most))
    keys = F.array(*[_packed(F.col(code), c, bits // bands) for c in choices])
    return df.select("*", F.posexplode(keys).alias(f"{prefix}combo", f"{prefix}key"))


def _first_common(different: Column, most: int, bands: int, bits: int) -> Column:
    """The number of the first choice of bands in which two codes agree, of the exclusive or of both."""
    agree = [_packed(different, (i,), bits // bands) == 0 for i in range(bands)]
    out = F.lit(None).cast("int")
    for n, choice in reversed(list(enumerate(itertools.combinations(range(bands), bands - most)))):
        out = F.when(functools.reduce(lambda x, y: x & y, [agree[i] for i in choice]), n).otherwise(out)
    return out


def pair_candidates(df: DataFrame, id_col: str, code: str, most: int, bands: int = 4, hot: int = HOT) -> DataFrame:
    """(c, i, m and d, j, n: two codes, i < j their least ids, m and n how many rows have them): the pairs that meet on the
    bands that they have in common, each once. Keys of more than ``hot`` codes are split by choices of bands of the rest."""
    codes = df.where(F.col(code).isNotNull()).groupBy(F.col(code).alias("c")).agg(F.min(id_col).alias("i"), F.count("*").alias("m"))
    keyed = band_keys(codes, "c", most, bands, 64, "")
    crowded = stored(keyed.groupBy("combo", "key").agg(F.count("*").alias("_n")).where(F.col("_n") > hot).select("combo", "key"))
    few = crowded.count()
    split = F.broadcast(crowded) if few <= SMALL else crowded
    different = F.col("c").bitwiseXOR(F.col("d"))

    def met(rows: DataFrame, on: list[str]) -> DataFrame:
        other = rows.select(*on, F.col("c").alias("d"), F.col("i").alias("j"), F.col("m").alias("n"))
        return rows.join(other, on).where(F.col("i") < F.col("j"))

    usual = met(keyed.join(split, ["combo", "key"], "left_anti") if few else keyed, ["combo", "key"]).where(_first_common(different, most, bands, 64) == F.col("combo"))
    out = usual.select("c", "i", "m", "d", "j", "n")
    rest_bits = most * (64 // bands)
    if few and most and rest_bits % bands == 0:
        # of a crowded key the other bands, packed, are a shorter code with as many bits to differ in
        rest = F.lit(None).cast("long")
        for n, choice in enumerate(itertools.combinations(range(bands), bands - most)):
            rest = F.when(F.col("combo") == n, _packed(F.col("c"), tuple(sorted(set(range(bands)) - set(choice))), 64 // bands)).otherwise(rest)
        inner = band_keys(keyed.join(split, ["combo", "key"], "left_semi").withColumn("rest", rest), "rest", most, bands, rest_bits, "r")
        other = inner.select("combo", "key", "rcombo", "rkey", F.col("c").alias("d"), F.col("i").alias("j"), F.col("m").alias("n"), F.col("rest").alias("other_rest"))
        both = inner.join(other, ["combo", "key", "rcombo", "rkey"]).where(F.col("i") < F.col("j"))
        once = (_first_common(different, most, bands, 64) == F.col("combo")) & (_first_common(F.col("rest").bitwiseXOR(F.col("other_rest")), most, bands, rest_bits) == F.col("rcombo"))
        out = out.union(both.where(once).select("c", "i", "m", "d", "j", "n"))
    elif few:
        out = out.union(met(keyed.join(split, ["combo", "key"], "left_semi"), ["combo", "key"]).where(_first_common(different, most, bands, 64) == F.col("combo")).select("c", "i", "m", "d", "j", "n"))
    return out


def near_pairs(df: DataFrame, id_col: str, code: str, most: int, bands: int = 4, hot: int = HOT) -> DataFrame:
    """(a, b, distance, copies_a, copies_b) of codes that differ in 1 to ``most`` bits, a < b being the least ids of either
    code, which so many rows have. Rows of one code are told by ``code_members``, so copies never make pairs.

    Such codes agree in bands - most of ``bands`` equal parts at least, so they meet in an equi-join on one choice of so
    many parts; with four bands and two bits that are six keys of 32 bits, which unlike codes seldom share.
    """
    if not most < bands <= 64 or 64 % bands:
        raise ValueError("more bands than differing bits are needed")
    if (bands - most) * (64 // bands) < 12:
        raise ValueError("keys of under 12 bits would join everything with everything")
    pairs = pair_candidates(df, id_col, code, most, bands, hot)
    near = pairs.withColumn("distance", hamming(F.col("c"), F.col("d"))).where(F.col("distance") <= most)
    return near.select(F.col("i").alias("a"), F.col("j").alias("b"), "distance", F.col("m").alias("copies_a"), F.col("n").alias("copies_b"))


def closest_pairs(pairs: DataFrame, rows: DataFrame, id_col: str, columns: list[str], n: int = 20) -> DataFrame:
    """The n pairs of the least distance, ties to the smaller ids, with what both sides' rows say, for a review."""
    first = pairs.orderBy("distance", "a", "b").limit(n)
    for side in ("a", "b"):
        named = rows.select(F.col(id_col).alias(f"_{side}"), *[F.col(c).alias(f"{c}_{side}") for c in columns])
        first = named.join(F.broadcast(first), F.col(f"_{side}") == F.col(side), "right").drop(f"_{side}")  # n rows
    return first


def changed_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that only one of two tables has; none if nothing has changed."""
    a = before.exceptAll(after).withColumn("only_in", F.lit("before"))
    return a.unionByName(after.exceptAll(before).withColumn("only_in", F.lit("after")))


def partition_digests(df: DataFrame, by: Column, parts: int = 4096) -> dict[str, str]:
    """A digest of each partition of a table, by a column's text: its rows' count, and the sums of the eight 32-bit words
    of their SHA-256, so no rows that were crafted for a sum of short hashes pass. Rows may be in any order."""
    told = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    rows = df.select(F.coalesce(by.cast("string"), F.lit("")).alias("part"), F.sha2(told, 256).alias("h"))
    words = [F.sum(F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("long")).alias(f"w{i}") for i in range(8)]
    found = rows.groupBy("part").agg(F.count("*").alias("n"), *words).limit(parts + 1).collect()
    if len(found) > parts:
        raise ValueError(f"a table has more than {parts} partitions")
    return {r["part"]: hashlib.sha256(json.dumps(list(r)[1:]).encode()).hexdigest() for r in found}


def merkle_root(leaves: dict[str, str], fan: int = 16) -> str:
    """The root of a tree of digests of partitions, in order of their names, ``fan`` of a node."""
    level = [hashlib.sha256(f"{len(k)}:{k}{v}".encode()).hexdigest() for k, v in sorted(leaves.items())] or [""]
    while True:
        level = [hashlib.sha256("".join(level[i : i + fan]).encode()).hexdigest() for i in range(0, len(level), fan)]
        if len(level) == 1:
            return level[0]


def table_digest(df: DataFrame, by: Column | None = None) -> str:
    """A digest of a table's rows in any order, and of its schema."""
    return hashlib.sha256(json.dumps([sorted(df.dtypes), merkle_root(partition_digests(df, F.lit("") if by is None else by))]).encode()).hexdigest()


def changed_partitions(before: DataFrame, after: DataFrame, by: Column) -> list[str]:
    """Names of the partitions whose rows differ, one side's only ones included."""
    a, b = partition_digests(before, by), partition_digests(after, by)
    return [] if merkle_root(a) == merkle_root(b) else sorted(k for k in a.keys() | b.keys() if a.get(k) != b.get(k))


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A left join whose keys must be unique on both sides, with those columns of the right side that the left one lacks."""
    require_empty(left.groupBy(*keys).count().where("count > 1"), "keys of the left side aren't unique")
    return unique_lookup(left, right.select(*keys, *[c for c in right.columns if c not in left.columns]), keys, "left", must_match=False)


def freeze(spark: SparkSession, path: str, tables: dict[str, DataFrame], settings: dict, by: dict[str, Column] | None = None) -> dict:
    """Write, once, what a run depends on: settings, and its tables' schemas and digests by partition."""
    leaves = {k: partition_digests(v, (by or {}).get(k, F.lit(""))) for k, v in tables.items()}
    protocol = {"settings": settings, "tables": {k: {"schema": sorted(map(list, v.dtypes)), "root": merkle_root(leaves[k]), "partitions": leaves[k]} for k, v in tables.items()}}
    write_once(spark, path, protocol)
    return protocol


def changed_tables(spark: SparkSession, path: str, tables: dict[str, DataFrame], settings: dict, by: dict[str, Column] | None = None) -> list[str]:
    """Which tables differ from what was frozen, or are missing, with the partitions that differ where these were named;
    "settings" if these differ."""
    frozen = json.loads(read_text(spark, path))
    changed = [] if frozen["settings"] == settings else ["settings"]
    for name, was in frozen["tables"].items():
        if name not in tables or sorted(map(list, tables[name].dtypes)) != was["schema"]:
            changed.append(name)
            continue
        now = partition_digests(tables[name], (by or {}).get(name, F.lit("")))
        if merkle_root(now) != was["root"]:
            changed += [name + (f"[{k}]" if name in (by or {}) else "") for k in sorted(now.keys() | was["partitions"].keys()) if now.get(k) != was["partitions"].get(k)]
    return changed


def verify(spark: SparkSession, path: str, tables: dict[str, DataFrame], settings: dict) -> None:
    """Raise if a table or a setting differs from what was frozen."""
    if changed := changed_tables(spark, path, tables, settings):
        raise ValueError(f"{', '.join(changed)}: not as frozen")


def claim(spark: SparkSession, path: str, after: str | None = None) -> None:
    """Take a step that may be taken once, and only after another one."""
    if after and not exists(spark, after):
        raise RuntimeError(f"{after} comes first")
    create(spark, path, "")


def commit_once(df: DataFrame, path: str, after: str | None = None) -> str:
    """Write a table that no other writer may replace: "written", or "kept" if equal rows are there already.

    The rows are staged in a folder of their own; the file that names it and their digest is created where none may exist,
    which is what takes the place. Of writers at the same time one takes it; the others delete what they staged, and fail
    unless their rows are the same. ``after``: a table that must be there before.
    """
    spark = df.sparkSession
    if after and not exists(spark, f"{after}/table.json"):
        raise RuntimeError(f"{after} comes first")
    held = stored(df)
    marker, digest = f"{path}/table.json", table_digest(held)
    if not exists(spark, marker):
        staged = f"{path}/rows-{uuid.uuid4().hex}"
        write_parquet(held, staged)
        try:
            create(spark, marker, json.dumps({"rows": staged, "digest": digest}))
            return "written"
        except FileExistsError:
            delete(spark, staged)
    if json.loads(read_text(spark, marker))["digest"] != digest:
        raise FileExistsError(f"{path} has other rows")
    return "kept"


def committed(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table that was written by ``commit_once``."""
    return spark.read.parquet(json.loads(read_text(spark, f"{path}/table.json"))["rows"])


def median_within(df: DataFrame, by: list[str], value: str, limit: float) -> DataFrame:
    """(by..., median_s, within): each group's median against a limit."""
    return linear_quantiles(df, value, {"median_s": 0.5}, by).withColumn("within", F.col("median_s") <= limit)


def within(seconds: float, action: Callable, clock: Callable[[], float] = time.monotonic):
    """The result of an action, which must not take longer."""
    began = clock()
    out = action()
    if clock() - began > seconds:
        raise TimeoutError(f"took more than {seconds} s")
    return out


def stopped_after(spark: SparkSession, seconds: float, action: Callable):
    """The result of an action whose Spark jobs are cancelled once it has taken so long, which raises TimeoutError. Jobs that
    it starts after that are cancelled, too; those of other threads go on."""
    context, group, done, late = spark.sparkContext, f"veldspar-{uuid.uuid4().hex}", threading.Event(), threading.Event()
    before = context.getLocalProperty("spark.jobGroup.id"), context.getLocalProperty("spark.job.description")

    def watch() -> None:
        wait = seconds
        while not done.wait(wait):
            late.set()
            context.cancelJobGroup(group)
            wait = 0.1

    context.setJobGroup(group, f"at most {seconds} s", interruptOnCancel=True)
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        return action()
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"stopped after {seconds} s") from e
        raise
    finally:
        done.set()
        watcher.join()
        context.setLocalProperty("spark.jobGroup.id", before[0])
        context.setLocalProperty("spark.job.description", before[1])
