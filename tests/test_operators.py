import struct
import threading
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldspar.operators import boards, components, governance, knn, links, manifests, metrics, order, raster, selection, strata
from veldspar.sources import files


def vectors(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids if ids is not None else range(len(x)), x)], "vec_id long, embedding array<float>")


def test_nearest_breaks_ties_by_the_smaller_id_and_counts_them(spark):
    bank = vectors(spark, [[0, 1], [1, 0], [0, 1], [5, 5]], [7, 3, 1, 9])
    rows = knn.nearest(vectors(spark, [[0, 0]], [100]), bank, 3).orderBy("rank").collect()
    assert [(r["bank_id"], r["distance"], r["ties"]) for r in rows] == [(1, 1.0, 3), (3, 1.0, 3), (7, 1.0, 3)]


def test_nearest_agrees_with_numpy_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(knn, "BROADCAST_BYTES", 0)
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 3, (20, 4)), rng.integers(0, 3, (50, 4))
    y[10:40] = y[3]  # more copies than a block keeps
    d = np.sqrt(((x[:, None, :] - y[None, :, :]) ** 2).sum(axis=2))
    index = knn.indexed(vectors(spark, y).repartition(3), 4, block=7, cell_rows=10)
    assert len(index.pivots) > 2 and index.blocks.count() > 3
    got = knn.nearest(vectors(spark, x), index, 4).collect()
    assert len(got) == 80
    for r in got:
        order = np.lexsort((np.arange(50), d[r["query_id"]]))
        assert r["bank_id"] == order[r["rank"] - 1] and r["ties"] == (d[r["query_id"]] == d[r["query_id"]].min()).sum()
    with pytest.raises(ValueError, match="for 4 neighbours"):
        knn.nearest(vectors(spark, x), index, 5)


def test_nearest_meets_few_blocks_of_a_bank_in_clusters(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 6)) * 10
    bank, asked = (centres[rng.integers(0, 30, n)] + rng.normal(size=(n, 6)) * 0.2 for n in (3000, 400))
    index = knn.indexed(vectors(spark, bank), 3, block=64, cell_rows=60)
    asked_blocks, pairs = knn.pairs_met(vectors(spark, asked), index, 3)
    assert pairs.count() < 0.4 * asked_blocks.count() * index.blocks.count()
    plan = knn.nearest(vectors(spark, asked), index, 3)._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "NestedLoop" not in plan and "CartesianProduct" not in plan
    d = np.sqrt(((np.float32(asked).astype(float)[:, None] - np.float32(bank).astype(float)[None]) ** 2).sum(axis=2))
    for r in knn.nearest(vectors(spark, asked), index, 3).collect():
        assert r["bank_id"] == np.lexsort((np.arange(3000), d[r["query_id"]]))[r["rank"] - 1]


def test_nearest_moves_each_block_a_fixed_number_of_times(spark):
    """However many pairs of blocks meet, which were what moved before."""
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(1500, 32)), rng.normal(size=(1600, 32))
    index = knn.indexed(vectors(spark, y), 2, block=20, cell_rows=40)
    asked = knn.stored(knn._asked(vectors(spark, x).withColumnsRenamed({"vec_id": "id", "embedding": "v"}), index, 2))
    moved, blocks = knn._tiles(asked, index).count(), asked.count() + index.blocks.count()
    _, pairs = knn.pairs_met(vectors(spark, x), index, 2)
    assert moved <= knn.GROUPS * blocks < pairs.count()
    d = np.sqrt(((np.float32(x).astype(float)[:, None] - np.float32(y).astype(float)[None]) ** 2).sum(axis=2))
    got = knn.nearest(vectors(spark, x), index, 2).collect()
    assert len(got) == 3000 and all(r["bank_id"] == np.argsort(d[r["query_id"]], kind="stable")[r["rank"] - 1] for r in got)


def test_searches_move_vectors_as_singles_where_these_hold_all_of_a_block(spark):
    """Half the bytes of doubles; the rows are those of doubles. Blocks with a number that only a double holds stay whole."""
    rng, schema = np.random.default_rng(8), "vec_id long, embedding array<double>"
    x = np.float32(rng.normal(size=(900, 16))).astype(float)
    x[::7, 3] *= -0.0
    mixed = x.copy()
    mixed[:40] = x[40] + rng.normal(size=(40, 16)) * 1e-12
    for bank, bytes_each in ((x, {4}), (mixed, {4, 8}), (x * 1e100, {8})):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(bank)], schema)
        index = knn.indexed(df, 3, block=50, cell_rows=100)
        asked = knn.stored(knn._asked(df.withColumnsRenamed({"vec_id": "id", "embedding": "v"}), index, 3))
        assert {r[0] for r in knn._tiles(asked, index).selectExpr("octet_length(values) div (octet_length(ids) * 2)").distinct().collect()} == bytes_each
        d = np.sqrt(((bank[:, None] - bank[None]) ** 2).sum(axis=2))
        near = np.argsort(d, axis=1, kind="stable")
        got = {(r["query_id"], r["rank"]): (r["bank_id"], r["distance"]) for r in knn.nearest(df, index, 3).collect()}
        assert len(got) == 2700 and all(got[i, k + 1] == (near[i, k], d[i, near[i, k]]) for i in range(900) for k in range(3))


def test_searches_take_products_in_singles_and_lose_no_row():
    """Also where singles can't tell the rows apart, or can't hold the values."""
    rng, k = np.random.default_rng(6), 3
    plain = rng.normal(size=(300, 8))
    grid = rng.integers(0, 3, size=(300, 8)).astype(float)
    for x in (plain, grid, plain * 0, plain + 1e7, plain * 1e30, plain * 1e-30, plain * 10.0 ** rng.integers(-30, 30, size=(300, 1))):
        i, j = (v.ravel() for v in np.indices((100, 300)))
        d = knn.distances(x, x, i, j).reshape(100, 300)
        group = knn._Group([(np.arange(100), x[:100].ravel(), np.sort(d, axis=1)[:, 9], np.array([0]), np.array([0.0]), np.array([1.0]))], k, 8)
        for a in range(0, 300, 70):
            group.meet(0, 0.0, 1.0, np.arange(a, min(300, a + 70)), x[a : a + 70], np.ones(len(x[a : a + 70]), np.int64))
        assert (group.near == np.argsort(d, axis=1, kind="stable")[:, :k]).all() and (group.d == np.sort(d, axis=1)[:, :k]).all()
        assert group.left.dtype == np.float32


def test_nearest_leaves_out_vectors_that_are_not_finite(spark):
    bank = vectors(spark, [[float("nan"), 0], [3, 4]])
    assert [r["distance"] for r in knn.nearest(vectors(spark, [[0, 0]]), bank, 2).collect()] == [5.0]
    assert knn.nearest(vectors(spark, [[0, 0]]), bank.limit(0), 2).count() == 0


def greedy_by_force(x, anchors, size):
    """The rule as stated: mean distance to the anchors, lowered by each centre; chosen rows are out."""
    x = np.asarray(x, float)
    least = np.mean([np.sqrt(((x - x[a]) ** 2).sum(axis=1)) for a in anchors], axis=0)
    out = []
    for _ in range(min(size, len(x))):
        i = int(np.argmax(np.where(np.isin(np.arange(len(x)), out), -np.inf, least)))
        out.append(i)
        least = np.minimum(least, np.sqrt(((x - x[i]) ** 2).sum(axis=1)))
    return out


@pytest.mark.parametrize("pool", [3, 17, 2048])
def test_greedy_coreset_agrees_with_a_direct_loop(spark, pool):
    x = np.random.default_rng(3).normal(size=(200, 4)).astype(np.float32).astype(float)
    df = vectors(spark, x)
    anchors = [r["vec_id"] for r in df.orderBy(F.xxhash64("vec_id"), "vec_id").limit(10).collect()]
    got = [r["id"] for r in knn.greedy_coreset(df.repartition(3), 40, pool=pool).orderBy("selection_order").collect()]
    assert got == greedy_by_force(x, anchors, 40)


def test_coreset_goes_on_over_repeated_rows(spark):
    x = [[1, 1]] * 5 + [[2, 2]]
    anchors = list(range(6))
    got = [r["id"] for r in knn.greedy_coreset(vectors(spark, x), 4, pool=2).orderBy("selection_order").collect()]
    assert got == greedy_by_force(x, anchors, 4)
    assert [r["id"] for r in knn.greedy_coreset(vectors(spark, [[1, 1]] * 12), 12, pool=4).orderBy("selection_order").collect()] == list(range(12))
    assert knn.greedy_coreset(vectors(spark, [[2, -3]]), 3).count() == 1
    assert knn.greedy_coreset(vectors(spark, [[1, 1]]).limit(0), 6).count() == 0


def test_near_pairs_finds_every_pair_of_codes(spark):
    rng = np.random.default_rng(5)
    codes = [int(c) for c in rng.integers(-(2**63), 2**63, 30)]
    codes += [c ^ (1 << int(rng.integers(0, 62))) for c in codes[:12]] + [c ^ 3 for c in codes[:6]] + codes[:3]
    df = spark.createDataFrame(list(enumerate(codes)), "id int, code long")
    got = {(r["a"], r["b"], r["distance"], r["copies_a"], r["copies_b"]) for r in governance.near_pairs(df, "id", "code", 2).collect()}
    bits = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    first = {c: codes.index(c) for c in codes}
    assert got == {(first[a], first[b], bits(a, b), codes.count(a), codes.count(b)) for a in first for b in first if first[a] < first[b] and bits(a, b) <= 2}
    assert {(r["id"], r["representative"]) for r in governance.code_members(df, "id", "code").collect()} == {(i, first[c]) for i, c in enumerate(codes)}
    with pytest.raises(ValueError):
        governance.near_pairs(df, "id", "code", 15, 16)


def test_near_pairs_split_crowded_keys_and_form_few_pairs(spark):
    rng = np.random.default_rng(6)
    base = int(rng.integers(0, 2**62)) & ~0xFFFFFFFF
    codes = [base | int(c) for c in rng.integers(0, 2**32, 400)]  # all share two bands
    codes += [c ^ (1 << int(rng.integers(0, 60))) ^ (1 << int(rng.integers(0, 60))) for c in codes[:60]] + codes[:5]
    df = spark.createDataFrame(list(enumerate(codes)), "id int, code long")
    bits = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    first = {}
    for i, c in enumerate(codes):
        first.setdefault(c, i)
    want = {(first[a], first[b], bits(a, b)) for a in first for b in first if first[a] < first[b] and bits(a, b) <= 2}
    for hot in (20, 100_000):
        rows = governance.near_pairs(df, "id", "code", 2, hot=hot).collect()
        assert len(rows) == len(want) and {(r["a"], r["b"], r["distance"]) for r in rows} == want
    everything, split = (governance.pair_candidates(df, "id", "code", 2, hot=h).count() for h in (100_000, 20))
    assert everything > 400 * 399 / 2 and split < 1000


def test_closure_over_links_with_circles(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d"), ("x", "y"), ("y", "a"), (None, "a"), ("a", None), ("a", "b")]
    reached = lambda seeds: {(r["node"], r["hops"]) for r in links.reachable(spark.createDataFrame(edges, "source string, target string"), spark.createDataFrame([(s,) for s in seeds], "node string")).collect()}
    assert reached(["a"]) == {("a", 0), ("b", 1), ("c", 2), ("d", 3)} and reached(["d", "x"]) == {("d", 0), ("x", 0), ("y", 1), ("a", 2), ("b", 3), ("c", 4)}
    assert reached([]) == set() and reached(["unknown"]) == {("unknown", 0)}


def test_digests_name_partitions_and_notice_crafted_rows(spark):
    rows = [(i % 3, i, f"v{i}") for i in range(30)] + [(0, None, None)]
    frame = lambda r: spark.createDataFrame(r, "k int, a int, b string")
    part = F.col("k")
    assert governance.changed_partitions(frame(rows), frame(rows[::-1]).repartition(3), part) == []
    assert governance.changed_partitions(frame(rows), frame([(k, a, "x" if a == 4 else b) for k, a, b in rows]), part) == ["1"]
    # two rows that have exchanged their values, a row that is there twice in place of another, a null in place of an empty text
    swapped = [(k, {3: 6, 6: 3}.get(a, a), b) for k, a, b in rows]
    assert governance.changed_partitions(frame(rows), frame(swapped), part) == ["0"]
    assert governance.changed_partitions(frame(rows), frame([rows[5] if r == rows[8] else r for r in rows]), part) == ["2"]
    assert governance.changed_partitions(frame(rows), frame(rows[:-1] + [(0, None, "")]), part) == ["0"]
    assert governance.changed_partitions(frame(rows), frame([*rows, (7, 1, "new")]), part) == ["7"]
    leaves = {str(i): str(i) for i in range(50)}
    assert governance.merkle_root(leaves) == governance.merkle_root(dict(reversed(leaves.items()))) != governance.merkle_root(leaves | {"9": "8", "8": "9"})
    with pytest.raises(ValueError, match="more than 2 partitions"):
        governance.partition_digests(frame(rows), part, 2)


def test_of_two_writers_of_a_table_one_stays(spark, tmp_path):
    path, rows = f"file://{tmp_path}/t", spark.range(50).withColumn("v", F.col("id") * 2)
    outcomes = []

    def write(df):
        try:
            outcomes.append(governance.commit_once(df, path))
        except FileExistsError:
            outcomes.append("refused")

    writers = [threading.Thread(target=write, args=(rows.withColumn("v", F.col("v") + i),)) for i in range(3)]
    [w.start() for w in writers]
    [w.join() for w in writers]
    assert sorted(outcomes) == ["refused", "refused", "written"]
    held = governance.committed(spark, path)
    shift = held.agg(F.min("v")).first()[0]
    assert held.count() == 50 and governance.commit_once(rows.withColumn("v", F.col("v") + shift).repartition(4), path) == "kept"
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("rows-")]) == 1
    with pytest.raises(RuntimeError, match="comes first"):
        governance.commit_once(rows, f"{path}-next", after=f"{path}-none")


def test_an_action_past_its_deadline_is_stopped(spark):
    def slow(batches):
        time.sleep(60)
        yield from batches

    began = time.monotonic()
    with pytest.raises(TimeoutError):
        governance.stopped_after(spark, 3, lambda: spark.range(4).mapInPandas(slow, "id long").collect())
    assert time.monotonic() - began < 30
    assert governance.stopped_after(spark, 60, lambda: spark.range(4).count()) == 4 and spark.range(5).count() == 5
    with pytest.raises(ValueError, match="own"):
        governance.stopped_after(spark, 60, lambda: (_ for _ in ()).throw(ValueError("its own")))


def test_selected_vectors_are_recovered_in_order(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 5))
    df = vectors(spark, x, range(60))
    chosen = knn.greedy_coreset(df, 7)
    rows = knn.recovered(chosen, df).orderBy("selection_order").collect()
    assert [r["vec_id"] for r in rows] == [r["id"] for r in chosen.orderBy("selection_order").collect()] and len(rows) == 7
    assert all(np.allclose(r["embedding"], x[r["vec_id"]], atol=1e-6) for r in rows)
    with pytest.raises(ValueError, match="no row"):
        knn.recovered(chosen, df.where("vec_id > 30"))


def test_quantiles_agree_with_numpy_by_group(spark):
    rng = np.random.default_rng(8)
    rows = [(str(i % 3), float(v)) for i, v in enumerate(np.round(rng.normal(size=200), 1))] + [(None, 2.0), (None, 5.0), ("1", None), ("1", float("nan")), ("x", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    named = {"a": 0.1, "b": 0.5, "c": 0.77}
    for got, method in ((order.linear_quantiles(df, "v", named, ["g"]), "linear"), (order.higher_quantiles(df, "v", named, ["g"]), "higher")):
        found = {r["g"]: [r["a"], r["b"], r["c"]] for r in got.collect()}
        groups = {g: [v for h, v in rows if h == g and v is not None and v == v] for g in ("0", "1", "2", None)}
        assert found.keys() == groups.keys() and all(np.allclose(found[g], np.quantile(v, list(named.values()), method=method)) for g, v in groups.items())
    whole = order.linear_quantiles(df, "v", {"m": 0.5}).collect()
    assert abs(whole[0]["m"] - np.median([v for _, v in rows if v is not None and v == v])) < 1e-12
    assert order.with_quantiles(df.groupBy("g").count(), df, {"v": {"m": 0.5}}, ["g"]).count() == 5


def test_ranges_follow_the_count_and_the_order_of_values(spark, monkeypatch):
    monkeypatch.setattr(order, "ROWS", 7)
    rng = np.random.default_rng(1)
    special = [0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, float("inf"), float("-inf"), 1.0, 2.0, 4.0, 1 - 2**-53, 2 - 2**-52, 1e-310]
    values = sorted({*special, *(rng.normal(size=300) * 10.0 ** rng.integers(-9, 9, 300)).tolist(), *np.linspace(1, 1.0001, 50).tolist()})
    df = spark.createDataFrame([(g, v) for g in ("a", None) for v in values], "g string, v double")
    binned = [r["b"] for r in df.where("g is null").orderBy("v").select(order.bin_of(F.col("v")).alias("b")).collect()]
    assert binned == sorted(binned)
    dealt = order.ranged(df, "v", ["g"]).where("g is null").orderBy("v").collect()
    ranges = [r["_range"] for r in dealt]
    assert ranges == sorted(ranges) and len(set(ranges)) > 30
    cum = order.running(df.withColumn("n", F.lit(1)), "v", ["n"], ["g"]).where("g = 'a'").orderBy("v").collect()
    assert [r["cum_n"] for r in cum] == list(range(1, len(values) + 1))
    down = order.running(df.withColumn("n", F.lit(1)), "v", ["n"], ["g"], descending=True).where("g = 'a'").orderBy("v").collect()
    assert [r["cum_n"] for r in down] == list(range(len(values), 0, -1))


def test_splits_keep_groups_whole_and_sized(spark):
    df = spark.createDataFrame([(f"g{i % 11}",) for i in range(50)], "g string")
    rows = governance.hash_split(df, "g").collect()
    assert len(rows) == 11 and sum(r["split"] == "calibration" for r in rows) == 3


def test_violations_and_lookup(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "id int, kind string")
    got = sorted((r["rule"], r["id"]) for r in governance.violations(df, "id", {"kind": F.col("kind") == "a"}, {"unique": (["id"], F.count("*") == 1)}).collect())
    assert got == [("kind", "1"), ("kind", "2"), ("unique", "1")]
    right = spark.createDataFrame([(1, "x")], "id int, v string")
    with pytest.raises(ValueError, match="without a row"):
        governance.unique_lookup(df, right, ["id"])
    with pytest.raises(ValueError, match="unique"):
        governance.unique_lookup(df, right.union(right), ["id"], must_match=False)


def test_frozen_protocol_notices_changes(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0)], "a int, b double")
    path = str(tmp_path / "p.json")
    governance.freeze(spark, path, {"t": df}, {"seed": 1})
    governance.verify(spark, path, {"t": df}, {"seed": 1})
    with pytest.raises(ValueError, match="t: not as frozen"):
        governance.verify(spark, path, {"t": df.union(df)}, {"seed": 1})
    assert governance.changed_tables(spark, path, {}, {"seed": 2}) == ["settings", "t"]
    with pytest.raises(FileExistsError):
        governance.freeze(spark, path, {"t": df}, {"seed": 1})
    with pytest.raises(RuntimeError):
        governance.claim(spark, str(tmp_path / "second"), after=str(tmp_path / "first"))


def test_write_same_accepts_equal_content_only(spark, tmp_path):
    path = str(tmp_path / "x.json")
    files.write_same(spark, path, {"a": 1})
    files.write_same(spark, path, {"a": 1})
    with pytest.raises(ValueError):
        files.write_same(spark, path, {"a": 2})
    with pytest.raises(ValueError):
        files.write_once(spark, str(tmp_path / "y.json"), float("nan"))


def test_joins_stop_at_repeated_keys(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    right = spark.createDataFrame([(1, "z", 5)], "k int, v string, w int")
    assert sorted(tuple(r) for r in governance.one_to_one(left, right, ["k"]).collect()) == [(1, "a", 5), (2, "b", None)]
    for a, b in ((left.union(left), right), (left, right.union(right))):
        with pytest.raises(ValueError):
            governance.one_to_one(a, b, ["k"])


def test_guards_stop_at_numbers_that_cannot_be_used(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 0)], "x double, y int")
    assert manifests.require_sound(df, ["x"], ["y"]).count() == 2
    for x, y in ((float("nan"), 1), (float("inf"), 1), (None, 1), (1.0, 2), (1.0, None)):
        with pytest.raises(ValueError):
            manifests.require_sound(df.union(spark.createDataFrame([(x, y)], df.schema)), ["x"], ["y"])
    with pytest.raises(ValueError):
        manifests.require_sound(df.limit(0), ["x"])
    with pytest.raises(ValueError):
        manifests.first_existing(df, ["a", "b"])


def test_paths_are_allowed_by_parts_and_suffix(spark):
    rows = {"src/Data/Images/Normal/a.JPG": True, "src/Data/Images/Normal/a.jpeg": True, "/src/Data/Images/Normal/a.jpg": False, "src/Data/Images/../a.jpg": False, "src/Data/Images/Normal/x/a.jpg": False, "src/Data/Images/Normal/a.gif": False, "src/Data/Images/Normal/jpg": False, "": False}
    df = spark.createDataFrame([(p,) for p in rows] + [(None,)], "p string")
    ok = manifests.allowed_path(F.col("p"), [F.lit(x) for x in ("src", "Data", "Images", "Normal")], manifests.SUFFIXES)
    assert {r["p"]: r["ok"] for r in df.select("p", ok.alias("ok")).collect()} == rows | {None: False}


def test_a_manifest_without_a_column_says_so(spark):
    df = spark.createDataFrame([("a", "b")], "image_id string, label string")
    assert {r["id"] for r in manifests.manifest_violations(df).collect()} == {"image_path", "mask_path", "official_split", "split", "sha256", "duplicate_group"}


def png(pixels):
    """A PNG of bytes (height, width) or (height, width, 3)."""
    h, w = pixels.shape[:2]
    raw = b"".join(b"\0" + pixels[y].tobytes() for y in range(h))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if pixels.ndim == 3 else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_images_and_masks_are_decoded(spark, tmp_path):
    rng = np.random.default_rng(1)
    colour, mask = rng.integers(0, 256, (5, 7, 3)).astype(np.uint8), (rng.random((6, 4)) < 0.4).astype(np.uint8) * 255
    (tmp_path / "a.png").write_bytes(png(colour))
    (tmp_path / "m.png").write_bytes(png(mask))
    (tmp_path / "broken.png").write_bytes(b"no image")
    got = {r["path"].rpartition("/")[2]: r for r in files.read_images(spark, str(tmp_path)).collect()}
    assert got.keys() == {"a.png", "m.png"}
    assert np.array_equal(np.frombuffer(got["a.png"]["data"], np.uint8).reshape(5, 7, 3)[:, :, ::-1], colour)
    assert [r["path"].rpartition("/")[2] for r in files.undecoded(spark, str(tmp_path)).collect()] == ["broken.png"]
    small = {r["path"].rpartition("/")[2]: np.array(r["mask"]).reshape(3, 2) for r in raster.masks(files.read_images(spark, str(tmp_path), "m.png"), 3, 2).collect()}
    assert np.array_equal(small["m.png"], mask[1::2, 1::2] > 0)
    rgb = {r["path"].rpartition("/")[2]: np.array(r["rgb"]).reshape(r["height"], r["width"], 3) for r in raster.decoded(files.read_images(spark, str(tmp_path), "a.png")).collect()}
    assert np.allclose(rgb["a.png"], colour / 255)


def test_features_come_from_a_registered_extractor(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0, 2.0, 3.0])], "image int, v array<double>")
    with pytest.raises(KeyError):
        raster.features(df, "image", "v", 2, "no such extractor")
    raster.register("corner", lambda image: [float(image[0, 0]), float(image.sum())])
    assert [tuple(r) for r in raster.features(df, "image", "v", 2, "corner").collect()] == [(1, [0.0, 6.0])]


def test_priority_selection_appends_later_rules(spark):
    tagged = spark.createDataFrame([("a", 2), ("a", 1), ("b", 1), ("c", 3)], "id string, rule int")
    got = [(r["id"], r["first_rule"], r["additional_rules"]) for r in selection.by_priority(tagged, "id", "rule", 2).orderBy("place").collect()]
    assert got == [("a", 1, "2"), ("b", 1, "")]


def test_groups_without_rows_are_kept(spark):
    dim = spark.createDataFrame([("a",), ("b",)], "g string")
    agg = spark.createDataFrame([("a", 2, 0.5)], "g string, n long, rate double")
    assert sorted((r["g"], r["n"], r["rate"]) for r in strata.keep_groups(dim, agg, ["g"], ["n"]).collect()) == [("a", 2, 0.5), ("b", 0, None)]


def test_peak_ties_and_overlap(spark):
    df = spark.createDataFrame([(1, [2.0, 2.0, 0.0, 0.0], [True, False, False, False])], "image int, score array<double>, truth array<boolean>")
    px = raster.pixels(df, "image", {"score": "score", "truth": "truth"}, 2)
    p = raster.peak(px, "image", "score", F.col("truth")).first()
    assert (p["peak"], p["y"], p["x"], p["peak_inside"], p["ties"]) == (2.0, 0, 0, True, 2)
    o = raster.overlap(px, ["image"], F.col("truth"), F.col("score") > 2.0).first()
    assert (o["both"], o["either"], o["iou"]) == (0, 1, 0.0)
    assert raster.overlap(px.withColumn("truth", F.lit(False)), ["image"], F.col("truth"), F.lit(False)).first()["iou"] is None


def flooded(mask, diagonal):
    """Numbers of components by flooding from each pixel in turn."""
    out, n = np.zeros(mask.shape, int), 0
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (diagonal or not (a and b))]
    for y, x in zip(*np.nonzero(mask)):
        if out[y, x]:
            continue
        n += 1
        out[y, x], open_ = n, [(y, x)]
        while open_:
            p, q = open_.pop()
            for a, b in steps:
                if 0 <= p + a < mask.shape[0] and 0 <= q + b < mask.shape[1] and mask[p + a, q + b] and not out[p + a, q + b]:
                    out[p + a, q + b] = n
                    open_.append((p + a, q + b))
    return out, n


def test_components_join_diagonally(spark):
    mask = np.array([[1, 0, 0, 1], [0, 1, 0, 0], [0, 0, 0, 1], [1, 0, 0, 1]], bool)
    assert raster.labelled(mask)[1] == 4 and raster.labelled(mask, diagonal=False)[1] == 5
    assert raster.extent(np.zeros((3, 3), bool)) == {"components": 0, "box_area": 0, "box_share": 0.0}
    rng = np.random.default_rng(0)
    for share in (0.3, 0.5, 0.6, 0.8):
        mask = rng.random((17, 23)) < share
        for diagonal in (True, False):
            got, want = raster.labelled(mask, diagonal), flooded(mask, diagonal)
            assert got[1] == want[1] and np.array_equal(got[0], want[0])


def test_closing_agrees_with_its_definition():
    rng = np.random.default_rng(4)
    mask = rng.random((12, 15)) < 0.3
    near = [(0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)]
    at = lambda m, y, x: 0 <= y < m.shape[0] and 0 <= x < m.shape[1] and m[y, x]
    each = lambda f, m: np.array([[f(bool(at(m, y + a, x + b)) for a, b in near) for x in range(m.shape[1])] for y in range(m.shape[0])])
    want = mask
    for f in (any, any, all, all):
        want = each(f, want)
    assert np.array_equal(raster.closed(mask, 2), want)


def test_turning_twice_changes_nothing(spark):
    df = spark.createDataFrame([(1, [float(i) for i in range(6)])], "image int, v array<double>")
    px = raster.pixels(df, "image", {"v": "v"}, 3)
    twice = raster.turned(raster.turned(px, 2, 3, F.lit(True)), 2, 3, F.lit(True))
    assert governance.changed_rows(px, twice).count() == 0
    assert {(r["y"], r["x"], r["v"]) for r in raster.turned(px, 2, 3, F.lit(True)).collect()} >= {(1, 2, 0.0), (0, 0, 5.0)}


def scene(above=True):
    rgb = np.full((160, 256, 3), 0.2)
    rgb[60:110, 50:200] = (0.1, 0.4, 0.7)
    for x in (100, 115, 130):
        rgb[(45 if above else 110) : (60 if above else 125), x : x + 2] = 0.8
    return rgb


def images(spark, **named):
    return spark.createDataFrame([(k, x.shape[0], x.shape[1], x.ravel().tolist()) for k, x in named.items()], "image string, height int, width int, rgb array<double>")


def test_boards_are_found_by_colour(spark):
    tiny = np.full((100, 100, 3), 0.2)
    tiny[:5, :5] = (0.1, 0.4, 0.7)
    wide = np.repeat(np.repeat(scene(), 4, axis=0), 4, axis=1)  # looked at on a copy of half the width
    found = {r["image"]: r for r in boards.boards(images(spark, usual=scene(), grey=np.full((20, 30, 3), 0.5), tiny=tiny, wide=wide)).collect()}
    box = lambda r: (r["x0"], r["y0"], r["x1"], r["y1"])
    crop = lambda r: (r["left"], r["top"], r["right"], r["bottom"])
    usual = found["usual"]
    assert box(usual) == (50, 60, 200, 110) and usual["failure"] is None and abs(usual["share"] - 150 * 50 / (160 * 256)) < 0.01 and crop(usual) == (38, 37, 212, 133)
    assert found["grey"]["failure"] == "no component" and crop(found["grey"]) == (0, 0, 30, 20) and box(found["grey"]) == (None,) * 4
    assert found["tiny"]["failure"] == "share out of bounds" and crop(found["tiny"]) == (0, 0, 100, 100)
    assert max(abs(a - 4 * b) for a, b in zip(box(found["wide"]), (50, 60, 200, 110))) <= 4


def test_pose_follows_the_pins(spark):
    both = np.maximum(scene(True), scene(False))
    seen = images(spark, above=scene(True), below=scene(False), turned=np.ascontiguousarray(scene(True)[::-1, ::-1]), both=both, none=both, upright=both)
    at = {"above": (50, 60, 200, 110), "below": (50, 60, 200, 110), "turned": (56, 50, 206, 100), "both": (50, 60, 200, 110), "none": (None,) * 4, "upright": (50, 60, 100, 110)}
    given = spark.createDataFrame([(k, *v) for k, v in at.items()], "image string, x0 int, y0 int, x1 int, y1 int")
    got = {r["image"]: r for r in boards.poses(seen, given, 256).collect()}
    assert {k: r["pose"] for k, r in got.items()} == {"above": "canonical", "below": "reversed_180", "turned": "reversed_180", "both": "uncertain", "none": "uncertain", "upright": "uncertain"}
    assert (got["above"]["pins_above"], got["above"]["pins_below"], got["turned"]["pins_below"]) == (3, 0, 3) and got["above"]["dominance"] == 90.0
    assert [got[k]["reason"] for k in ("above", "both", "none", "upright")] == ["", "ambiguous", "no board", "not lying"]
    x = raster.tensor(np.full((2, 2, 3), 0.485))
    assert x.shape == (3, 2, 2) and abs(x[0]).max() < 1e-12 and abs(x[1, 0, 0] - (0.485 - 0.456) / 0.224) < 1e-12


@pytest.mark.parametrize("diagonal", [True, False])
def test_components_of_tiles_are_those_of_the_whole_raster(spark, diagonal):
    rng = np.random.default_rng(12)
    masks = {"thin": rng.random((40, 70)) < 0.55, "spiral": np.zeros((41, 41), bool), "empty": np.zeros((9, 9), bool)}
    for i in range(0, 20, 2):  # rings, each open at one place
        masks["spiral"][i : 41 - i, i : 41 - i] = True
        masks["spiral"][i + 1 : 40 - i, i + 1 : 40 - i] = False
        masks["spiral"][i + 1, i : i + 2] = True
    tiles = []
    for name, mask in masks.items():
        ys, xs = ([0, *sorted(rng.choice(np.arange(1, n), 5, replace=False).tolist()), n] for n in mask.shape)
        tiles += [(name, a, c, d - c, mask[a:b, c:d].ravel().tolist()) for a, b in zip(ys, ys[1:]) for c, d in zip(xs, xs[1:])]
    runs = components.components(spark.createDataFrame(tiles, "image string, top int, left int, width int, mask array<boolean>").repartition(5), diagonal=diagonal)
    rows = runs.collect()
    for name, mask in masks.items():
        names, n = raster.labelled(mask, diagonal)
        pairs = {(r["component"], int(names[r["y"], x])) for r in rows if r["image"] == name for x in range(r["first"], r["last"] + 1)}
        assert len(pairs) == n == len({a for a, _ in pairs}) == len({b for _, b in pairs})
        assert sum(r["last"] - r["first"] + 1 for r in rows if r["image"] == name) == mask.sum()
    biggest = components.extents(runs).where("image = 'spiral'").orderBy(F.desc("pixels")).first()
    assert (biggest["x0"], biggest["y0"], biggest["x1"], biggest["y1"], biggest["top"], biggest["left_of_top"]) == (0, 0, 40, 40, 0, 0)


def test_components_of_a_long_way_and_of_none(spark):
    way = [(i, i + 1) for i in range(500)] + [(1000 + i, 1000) for i in range(50)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components.unite(spark.createDataFrame(way, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(501), 0), **dict.fromkeys(range(1000, 1050), 1000)}
    assert components.unite(spark.createDataFrame([], "a long, b long")).count() == 0


def test_geometry_of_images():
    square, g = raster.boxed(np.full((20, 10), 7.0), 20)
    assert (g["content_height"], g["content_width"], g["pad_y"], g["pad_x"]) == (20, 10, 0, 5)
    assert square[0, 0] == 128 and square[0, 5] == 7
    back = raster.unboxed(square, g, (2, 3, 12, 23), 30, 20)
    assert back[0, 0] == 0 and back[3, 2] == 7 and back[22, 11] == 7
    assert raster.unboxed(square, g, (0, 0, 20, 30), 30, 20, common=5).tolist() == np.full((5, 5), 7.0).tolist()
    assert np.allclose(raster.resized(np.arange(16.0).reshape(4, 4), 4, 4), np.arange(16).reshape(4, 4))


def test_hashes_tell_where_brightness_rises():
    assert raster.difference_hash(np.tile(np.arange(18.0), (16, 1))) == -1 and raster.difference_hash(np.zeros((16, 18))) == 0


def test_p_values_agree_with_known_ones(spark):
    # two-sided tails of Student's t from tables
    for t, degrees, p in ((2.228, 10, 0.05), (12.706, 1, 0.05), (1.96, 1e7, 0.05), (0.0, 5, 1.0), (3.169, 10, 0.01)):
        assert abs(metrics.student_p(t, degrees) - p) < 2e-4
    assert metrics.spearman_p(1.0, 10) == 0.0 and metrics.spearman_p(0.5, 2) is None
    row = spark.range(1).select(metrics.kolmogorov_p(F.lit(0.0), F.lit(50), F.lit(60)).alias("a"), metrics.kolmogorov_p(F.lit(1.0), F.lit(50), F.lit(60)).alias("b")).first()
    assert row["a"] == 1.0 and row["b"] < 1e-12


def test_a_model_is_saved_and_read_again(spark, tmp_path):
    rng = np.random.default_rng(2)
    normal, calibration, other = (vectors(spark, rng.normal(size=(n, 4)), range(a, a + n)) for n, a in ((40, 0), (20, 100), (10, 200)))
    model = knn.fit(normal, calibration, 0.9)
    knn.save(model, str(tmp_path / "m"))
    again = knn.load(spark, str(tmp_path / "m"))
    assert again.threshold == model.threshold
    assert sorted(map(tuple, knn.inspected(again, other).collect())) == sorted(map(tuple, knn.inspected(model, other).collect()))
    assert knn.inspected(model, calibration).where("flagged").count() <= 2
    with pytest.raises(Exception):
        knn.save(model, str(tmp_path / "m"))


def test_maps_hold_each_patch(spark):
    rows = [(1, 0, 5, 1.0), (1, 1, 6, 3.0), (1, 3, 7, 3.0), (2, 2, 1, 0.5)]
    patches = spark.createDataFrame(rows, "image_id int, patch long, bank_id long, distance double")
    got = {r["image_id"]: r for r in knn.image_scores(patches, 2, 2).collect()}
    assert (got[1]["patch"], got[1]["row"], got[1]["column"], got[1]["bank_id"], got[1]["score"]) == (1, 0, 1, 6, 3.0) and got[2]["row"] == 1
    maps = {r["image_id"]: r["map"] for r in knn.image_maps(patches, 2, 2, 2).collect()}
    assert maps == {1: [1.0, 3.0, 0.0, 3.0], 2: [0.0, 0.0, 0.5, 0.0]}


def test_strokes_take_medians_only_where_pins_may_be(monkeypatch):
    rgb = np.full((200, 300, 3), 0.4)
    rgb[60:90, 150:153], rgb[95:120, 60:240] = 0.9, (0.1, 0.5, 0.6)
    sizes, whole = [], raster.median_rows

    def told(image, width, columns=slice(None)):
        out = whole(image, width, columns)
        sizes.append(out.size)
        assert np.array_equal(out, whole(image, width)[:, columns])
        return out

    monkeypatch.setattr(boards, "median_rows", told)
    found = boards.strokes(rgb, 60, 95, 240, 165)
    assert found["side"].to_pylist() == ["above"] * 3 and found["x"].to_pylist() == [36, 37, 38]
    assert sum(sizes) < rgb.shape[0] * rgb.shape[1] / 4
