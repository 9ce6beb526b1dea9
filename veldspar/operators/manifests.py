"""Manifests of images: what must hold of their rows, groups and splits before they may be used.

Every check gives the rows that break a rule, as (rule, id), so that a caller can report them all or stop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .governance import violations

REQUIRED = ["image_id", "image_path", "mask_path", "label", "official_split", "split", "sha256", "duplicate_group"]
#: Folders below a source's own one, and suffixes in lower case.
IMAGES, MASKS, SUFFIXES = ["Data", "Images"], ["Data", "Masks"], [".jpg", ".jpeg", ".png"]


def hexadecimal(value: Column, digits: int) -> Column:
    return value.rlike(f"^[0-9a-f]{{{digits}}}$")


def one_of(value: Column, names: list[str]) -> Column:
    return value.isin(*names)


def given(value: Column) -> Column:
    return F.coalesce(value, F.lit("")) != ""


def allowed_path(path: Column, parts: list[Column | str], suffixes: list[str]) -> Column:
    """A relative path of the given folders and a file with one of the suffixes, in any case, and no step upwards."""
    steps = F.split(path, "/")
    inside = (F.size(steps) == len(parts) + 1) & ~F.array_contains(steps, "..")
    for i, part in enumerate(parts):
        inside = inside & (F.get(steps, F.lit(i)) == part)
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    return F.coalesce(inside & suffix.isin(*suffixes), F.lit(False))


def absent_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def missing_values(df: DataFrame, column: str, values: list[str], rule: str) -> DataFrame:
    """(rule, id) for each of some values that no row has."""
    asked = df.sparkSession.createDataFrame([(v,) for v in values], "id string")
    found = df.select(F.col(column).alias("id")).distinct()
    return asked.join(found, "id", "left_anti").select(F.lit(rule).alias("rule"), "id")


def manifest_violations(df: DataFrame) -> DataFrame:
    """All that is wrong with a manifest of images; a table without a required column has no other violation."""
    if absent := absent_columns(df, REQUIRED):
        return df.sparkSession.createDataFrame([("required_columns", c) for c in absent], "rule string, id string")
    c = F.col
    training, anomaly = c("split") != "test", c("label") == "anomaly"
    rows = {
        "split_known": one_of(c("split"), ["fit", "calibration", "test"]),
        "official_split_known": one_of(c("official_split"), ["train", "test"]),
        "image_id_form": hexadecimal(c("image_id"), 24),
        "sha256_form": hexadecimal(c("sha256"), 64),
        "group_is_sha256": c("sha256") == c("duplicate_group"),
        "path_given": given(c("image_path")),
        "label_known": one_of(c("label"), ["normal", "anomaly"]),
        "only_normals_train": ~training | (c("label") == "normal"),
        "anomaly_has_mask": ~anomaly | given(c("mask_path")),
        "official_test_kept": (c("official_split") != "test") | (c("split") == "test"),
        "official_train_kept": (c("official_split") != "train") | (c("split") != "test"),
    }
    groups = {
        "unique_id": (["image_id"], F.count("*") == 1),
        "unique_path": (["image_path"], F.count("*") == 1),
        "one_label_per_file": (["sha256"], F.countDistinct("label") == 1),
        "one_split_per_file": (["sha256"], F.countDistinct("split") == 1),
    }
    return violations(df, "image_id", rows, groups).unionByName(missing_values(df, "split", ["fit", "calibration", "test"], "split_nonempty"))


def normal_violations(df: DataFrame, annotations: list[str]) -> DataFrame:
    """Of a manifest that must hold normal images only: no annotation filled in, and no file in two splits."""
    splits = ["fit", "calibration", "normal_test"]
    rows = {"only_normal": F.col("label") == "normal", "split_known": one_of(F.col("split"), splits)}
    rows |= {f"no_{a}": ~given(F.col(a)) for a in annotations if a in df.columns}
    groups = {"unique_id": (["image_id"], F.count("*") == 1), "one_split_per_file": (["sha256"], F.countDistinct("split") == 1)}
    return violations(df, "image_id", rows, groups).unionByName(missing_values(df, "split", splits, "split_nonempty"))


def confirmation_violations(df: DataFrame, normals: DataFrame) -> DataFrame:
    """Of the images that confirm a frozen model: the normal ones are exactly those held out, with the same files, and
    neither ids nor files were used to build it."""
    rows = {"label_known": one_of(F.col("label"), ["normal", "anomaly"])}
    found = violations(df, "image_id", rows, {"unique_id": (["image_id"], F.count("*") == 1), "unique_file": (["sha256"], F.count("*") == 1)})
    held = normals.where("split = 'normal_test'").select("image_id", "sha256")
    seen = df.where("label = 'normal'").select("image_id", "sha256")
    built = normals.where("split IN ('fit', 'calibration')")
    named = lambda rows, rule, key="image_id": rows.select(F.lit(rule).alias("rule"), F.col(key).alias("id")).distinct()
    return (
        found.unionByName(named(held.exceptAll(seen), "held_out_missing"))
        .unionByName(named(seen.exceptAll(held), "held_out_changed"))
        .unionByName(named(df.join(built.select("image_id"), "image_id", "left_semi"), "id_leaks"))
        .unionByName(named(df.join(built.select("sha256"), "sha256", "left_semi"), "file_leaks", "sha256"))
        .unionByName(missing_values(df, "label", ["anomaly"], "label_nonempty"))
    )


def routes(df: DataFrame, source: str, label: str) -> DataFrame:
    """Rows (object, official_split, label, image, mask) of one source and label whose paths are allowed, by image."""
    folder = {"normal": "Normal", "anomaly": "Anomaly"}[label]
    ok = allowed_path(F.col("image"), [F.lit(source), *[F.lit(x) for x in IMAGES], F.lit(folder)], SUFFIXES)
    return df.where((F.col("object") == source) & (F.col("label") == label) & one_of(F.col("official_split"), ["train", "test"]) & ok).orderBy("image")


def route_violations(df: DataFrame) -> DataFrame:
    """(rule, image): paths that don't fit the row's source and label, masks where none may be or that are missing."""
    folder = F.when(F.col("label") == "anomaly", "Anomaly").otherwise("Normal")
    mask = allowed_path(F.col("mask"), [F.col("object"), *[F.lit(x) for x in MASKS], F.lit("Anomaly")], [".png"])
    rows = {
        "label_known": one_of(F.col("label"), ["normal", "anomaly"]),
        "path_fits_label": allowed_path(F.col("image"), [F.col("object"), *[F.lit(x) for x in IMAGES], folder], SUFFIXES),
        "mask_fits_label": F.when(F.col("label") == "anomaly", mask).otherwise(~given(F.col("mask"))),
    }
    return violations(df, "image", rows, {"unique_image": (["image"], F.count("*") == 1)})


def coordinate_violations(traces: DataFrame, memory: DataFrame, id_col: str, coordinates: dict[str, int], reference: list[str]) -> DataFrame:
    """(rule, id): coordinates that aren't whole numbers within 0 and their bound, and references that the memory lacks."""
    rows = {f"{c}_in_grid": ~F.isnan(F.col(c).cast("double")) & (F.col(c) >= 0) & (F.col(c) < bound) & (F.col(c) == F.floor(F.col(c).cast("double"))) for c, bound in coordinates.items()}
    lost = traces.join(memory.select(*reference).distinct(), reference, "left_anti")
    return violations(traces, id_col, rows).unionByName(lost.select(F.lit("reference_known").alias("rule"), F.col(id_col).cast("string").alias("id")))


def guard_counts(df: DataFrame, numbers: list[str], labels: list[str] = ()) -> DataFrame:
    """(column, rows, bad): numbers that are null or not finite, and labels that aren't 0 or 1."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    bad = {c: ~finite(c) for c in numbers} | {c: ~F.coalesce(F.col(c).isin(0, 1), F.lit(False)) for c in labels}
    counts = df.agg(F.count("*").alias("rows"), *[F.count_if(b).alias(c) for c, b in bad.items()])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("bad")) for c in bad]))
    return counts.select("rows", each.alias("e")).select("e.column", "rows", "e.bad")


def require_sound(df: DataFrame, numbers: list[str], labels: list[str] = ()) -> DataFrame:
    """``df``, if it has rows, all numbers are finite and all labels 0 or 1; else an error."""
    for r in guard_counts(df, numbers, labels).collect():
        if not r["rows"] or r["bad"]:
            raise ValueError(f"{r['column']}: {r['bad']} of {r['rows']} values can't be used")
    return df


def setting_violations(settings: DataFrame, expected: dict[str, str]) -> DataFrame:
    """(key, expected, found): settings (key, value) that aren't what was fixed, or are missing."""
    asked = settings.sparkSession.createDataFrame(list(expected.items()), "key string, expected string")
    met = asked.join(settings.select("key", F.col("value").alias("found")), "key", "left")
    return met.where(~F.col("expected").eqNullSafe(F.col("found")))


def first_existing(df: DataFrame, names: list[str]) -> Column:
    """The first of some columns that the table has."""
    for name in names:
        if name in df.columns:
            return F.col(f"`{name}`")
    raise ValueError(f"none of {names} is a column")
