"""Stores, merging states, maps, shapes, fidelity and the splits by key range, against brute force."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import features as feats
from tessella.functions import labels
from tessella.operators import clustering, components, pyramid, raster, tables
from tessella.sources import store


def vectors(spark, x, **more):
    return spark.createDataFrame([(i, [float(v) for v in r], *(c[i] for c in more.values())) for i, r in enumerate(x)], ", ".join(["id long, vec array<double>", *(f"{c} string" for c in more)]))


# stores


def test_broken_files_are_listed(spark, tmp_path):
    root, cache = str(tmp_path / "store"), str(tmp_path / "cache")
    rows = [(k, f"k{j}", f"f{j % 3}", [1.5, float("nan"), float("inf"), None][j % 4]) for k in range(4) for j in range(8)]
    spark.createDataFrame(rows, "slide_id int, key string, feature string, v double").repartition("slide_id").write.partitionBy("slide_id").parquet(root)
    os.makedirs(f"{root}/slide_id=9")
    with open(f"{root}/slide_id=9/part-broken.parquet", "wb") as f:
        f.write(b"PAR1 not a file")

    def read(options=None):
        got, failed = store.consolidated(spark, root, cache, options or {"mpp": 0.5}, pattern="part-*")
        return got, [(r["slide_id"], r["error"] is not None) for r in failed.collect()]

    got, failed = read()
    assert failed == [("9", True)] and got.select("slide_id").distinct().count() == 4
    assert sorted((int(r["slide_id"]), r["key"], r["feature"], r["v"]) for r in got.collect()) == sorted((a, b, c, v if v is not None and math.isfinite(v) else 0.0) for a, b, c, v in rows)
    # nothing new: the cache answers; a changed file replaces its rows; a mended one is no failure any more; one that is gone is gone
    held = len(os.listdir(f"{cache}/rows"))
    assert read()[1] == failed and len(os.listdir(f"{cache}/rows")) == held
    spark.createDataFrame([("a", "f", 7.0)], "key string, feature string, v double").coalesce(1).write.parquet(str(tmp_path / "one"))
    whole = next(p for p in os.listdir(tmp_path / "one") if p.startswith("part-"))
    os.replace(tmp_path / "one" / whole, f"{root}/slide_id=9/part-broken.parquet")
    got, failed = read()
    assert failed == [] and [r["v"] for r in got.where("slide_id = '9'").collect()] == [7.0]
    os.remove(f"{root}/slide_id=9/part-broken.parquet")
    assert read()[0].where("slide_id = '9'").count() == 0
    with pytest.raises(ValueError, match="cache was made with"):
        read({"mpp": 0.25})


# components


def test_states_of_any_split(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(240, 5)) @ rng.normal(size=(5, 5)) + 100
    slides = [str(v) if v else None for v in rng.integers(0, 4, len(x))]
    points = vectors(spark, x, slide=slides)
    once, states = components.fit(points, 3)
    assert states.count() == 1
    value, vector = np.linalg.eigh(np.cov(x.T))
    assert np.allclose(once.variance, value[::-1][:3]) and np.allclose(once.mean, x.mean(0))
    assert np.allclose(np.abs((once.directions * vector.T[::-1][:3]).sum(1)), 1)
    by_slide, states = components.fit(points, 3, ["slide"])
    assert {r["slide"]: r["n"] for r in states.collect()} == {s: slides.count(s) for s in set(slides)}
    first, known = components.fit(points.where("id < 100"), 3, ["slide"])
    later, _ = components.fit(points.where("id >= 100"), 3, ["slide"], known=known)
    for other in (by_slide, later):
        assert np.allclose(other.variance, once.variance) and np.allclose(other.directions, once.directions, atol=1e-6) and np.allclose(other.mean, once.mean)
    assert not np.allclose(first.variance, once.variance)
    white = np.array([r["components"] for r in components.project(points, once, whiten=True).orderBy("id").collect()])
    assert np.allclose(np.cov(white.T), np.eye(3)) and np.allclose(white.mean(0), 0, atol=1e-8)
    flat, _ = components.fit(vectors(spark, np.ones((3, 2))))
    assert np.allclose(flat.variance, 0)
    assert all(r["components"] == [0.0, 0.0] for r in components.project(vectors(spark, np.ones((3, 2))), flat, whiten=True).collect())


def test_map_phases(spark):
    """From the main plane no worse than from drawn rows, and the same at every run."""
    for seed in range(3):
        rng = np.random.default_rng(seed)
        x = rng.normal(size=(300, 6)) * [4, 2, 1, 0.5, 0.2, 0.1] + rng.integers(0, 3, (300, 1))
        points = vectors(spark, x).cache()
        book = clustering.phased_som(points, 3, 4)
        assert np.allclose(book, clustering.phased_som(points, 3, 4))
        drawn = clustering.som(points, 3, 4, rounds=12, seed=seed)
        assert clustering.quantisation_error(points, book) <= 1.02 * clustering.quantisation_error(points, drawn)
        points.unpersist()


def test_consensus_counts(spark):
    """Pairs by their numbers of common draws, counted from patterns, against all pairs."""
    rng = np.random.default_rng(2)
    points = vectors(spark, rng.normal(size=(60, 3)) + rng.integers(0, 2, (60, 1)) * 3)
    got = {r["k"]: r["area"] for r in clustering.consensus(points, [2, 3], times=3, share=0.7).collect()}
    from tessella.operators.tables import resample

    for k in (2, 3):
        codes = np.full((60, 3), -1)
        for draw in range(3):
            chosen = resample(points, "id", draw + 1, 0.7, 0).where(F.col("draw") == draw).drop("draw")
            for r in clustering.kmeans(chosen, k, rounds=5, seed=draw)[1].collect():
                codes[r["id"], draw] = r["code"]
        values = []
        for i in range(60):
            for j in range(i):
                both = (codes[i] >= 0) & (codes[j] >= 0)
                if both.any():
                    values.append((codes[i] == codes[j])[both].mean())
        hist = np.bincount(np.minimum((np.array(values) * 10).astype(int), 9), minlength=10)
        assert got[k] == pytest.approx((np.cumsum(hist) / hist.sum() / 10)[:-1].sum(), abs=0.11)


# splits


@pytest.mark.parametrize("parts", [1, 4, 50])
def test_slices_by_range(spark, parts):
    rows = [(g, k) for g, n in (("a", 23), ("b", 3), (None, 11)) for k in range(n)]
    df = spark.createDataFrame(rows, "g string, k long")
    got = {(r["g"], r["k"]): (r["part"], r["fold"]) for r in tables.folds(tables.slices(df, ["g"], [-F.col("k")], parts), ["g"], "k", 5).collect()}
    for g, n in (("a", 23), ("b", 3), (None, 11)):
        want = [p for p, own in enumerate(np.array_split(np.arange(n), parts)) for _ in own]
        assert [got[g, k][0] for k in reversed(range(n))] == want
        assert [got[g, k][1] for k in range(n)] == [k % 5 for k in range(n)]
    whole = tables.slices(df, [], [F.col("g"), F.col("k")], 3).orderBy(F.col("g").asc_nulls_first(), "k").collect()
    assert [r["part"] for r in whole] == [p for p, own in enumerate(np.array_split(np.arange(37), 3)) for _ in own]
    assert tables.slices(df.where("false"), ["g"], [F.col("k")], 3).count() == 0


def test_union_of_many_masks(spark):
    rng = np.random.default_rng(0)
    masks = [(k % 3 if k % 7 else None, (rng.random((6, 5)) < 0.05) * 200) for k in range(200)]
    df = spark.createDataFrame([(k, raster.pack(m)) for k, m in masks], f"g int, mask {raster.CELL}").repartition(5)
    got = {r["g"]: raster.unpack(r["mask"].asDict()) for r in raster.union_masks(df, ["g"], parts=3).collect()}
    assert set(got) == {0, 1, 2, None}
    for g, m in got.items():
        assert (m == np.where(np.logical_or.reduce([a > 0 for k, a in masks if k == g]), 255, 0)).all()


def test_param_values(spark):
    texts = ["3", "1:4", "1:2:0.25", "1;9;2.5", "4:1", "-1.5"]
    got = {r["t"]: r["v"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", tables.param_values(F.col("t")).alias("v")).collect()}
    assert got == {t: tables.parse_param(t) for t in texts}


# images


def test_fidelity():
    rng = np.random.default_rng(3)
    a = np.clip(rng.normal(size=(40, 48)).cumsum(0).cumsum(1) * 4 + 128, 0, 255)
    assert raster.fidelity(a, a) == pytest.approx(1, abs=1e-6)
    assert raster.fidelity(np.full((20, 20), 7.0), rng.random((20, 20))) == 1.0
    soft, noisy = raster.gaussian(a, 1.5), a + rng.normal(size=a.shape) * 20
    assert 0 < raster.fidelity(a, noisy) < 0.9 and 0 < raster.fidelity(a, soft) < 0.95
    assert raster.fidelity(a, a + rng.normal(size=a.shape) * 40) < raster.fidelity(a, noisy)


def test_gaussian_is_a_kernel_sum():
    rng = np.random.default_rng(5)
    for shape, sigma in (((7, 9), 0.8), ((3, 4), 2.0)):
        a = rng.random(shape)
        r = int(4 * sigma + 0.5)
        k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
        k = np.outer(k, k) / k.sum() ** 2
        mirror = lambda i, n: (i % (2 * n)) if (i % (2 * n)) < n else 2 * n - 1 - (i % (2 * n))
        want = [[sum(k[dy + r, dx + r] * a[mirror(y + dy, shape[0]), mirror(x + dx, shape[1])] for dy in range(-r, r + 1) for dx in range(-r, r + 1)) for x in range(shape[1])] for y in range(shape[0])]
        assert np.allclose(raster.gaussian(a, sigma), want)


def run_feature(name, **given):
    fn, names, args = feats.REGISTRY[name]
    return dict(zip(names, fn(*(given[a] for a in args)), strict=True))


def test_region_shapes():
    mask = np.zeros((60, 80), np.uint8)
    y, x = np.mgrid[:60, :80]
    mask[(x - 30) ** 2 + (y - 28) ** 2 <= 20**2] = 200
    mask[22:30, 26:38] = 250
    gray = np.where(mask == 200, 3, 1).astype(np.uint8)
    got = run_feature("regions", mask=mask, gray=gray)
    assert len(got) == 67 and got["inner_regions"] == 1 and got["inner_area"] == 96 and got["outer_area"] == (mask == 200).sum()
    assert got["inner_extent"] == got["inner_solidity"] == 1
    assert got["inner_hu_1"] == pytest.approx(((12**2 - 1) + (8**2 - 1)) / 12 / 96)  # a rectangle's second moments
    assert got["resized_outer_eccentricity"] < 0.1 and got["resized_outer_hu_1"] == pytest.approx(1 / (2 * math.pi), rel=0.01)  # a disc's
    assert got["resized_outer_extent"] == pytest.approx((mask > 0).sum() / 41**2, abs=0.01)
    assert got["outer_weighted_hu_1"] == pytest.approx(got["outer_hu_1"] / 3)  # mass three times as large
    alone = run_feature("regions", mask=np.where(mask == 200, 200, 0), gray=gray)
    assert alone["inner_regions"] == 0 and alone["inner_area"] == 0 and alone["outer_area"] == got["outer_area"]
    tall = run_feature("regions", mask=np.pad(np.ones((9, 2), np.uint8), 3), gray=np.ones((15, 8), np.uint8))
    assert tall["outer_inertia_1"] == pytest.approx((9**2 - 1) / 12) and tall["outer_inertia_2"] == pytest.approx((2**2 - 1) / 12)
    cross = np.zeros((9, 9), np.uint8)
    cross[4], cross[:, 4] = 1, 1
    assert 0.3 < run_feature("regions", mask=cross, gray=cross)["outer_solidity"] < 0.5


def test_texture_by_channel_and_direction():
    stripes = np.tile(np.array([[0, 255]], np.uint8), (8, 4))
    image = np.stack([stripes, stripes.T, np.full((8, 8), 9, np.uint8)], 2)
    mask = np.ones((8, 8), np.uint8)
    got = {c: run_feature(f"{c}_haralick", image=image, gray=stripes, mask=mask) for c in ("gray", "red", "green", "blue")}
    assert all(len(v) == 52 for v in got.values())
    assert got["red"]["red_haralick_0_2"] == 255**2 and got["red"]["red_haralick_90_2"] == 0  # contrast across and along stripes
    assert got["green"]["green_haralick_0_2"] == 0 and got["green"]["green_haralick_90_2"] == 255**2
    assert got["blue"]["blue_haralick_0_1"] == 1 and got["blue"]["blue_haralick_135_9"] == 0  # one level: certain
    assert list(got["gray"].values()) == list(got["red"].values())
    none = run_feature("gray_haralick", gray=stripes, mask=mask * 0)
    assert none["gray_haralick_0_2"] == 0


def test_nuclei():
    mask = np.full((60, 90), 200, np.uint8)
    mask[10:21, 10:21] = 50  # a square of side 10 between middles
    y, x = np.mgrid[:60, :90]
    mask[(x - 60) ** 2 + (y - 30) ** 2 <= 15**2] = 50
    mask[50, 80] = 50  # too small to have an outline
    got = run_feature("nuclei", mask=mask)
    square, disc = 40 / (2 * math.pi), got["radius_mean"] * 2 - 40 / (2 * math.pi)
    assert disc == pytest.approx(15, rel=0.08) and got["nuclei"] == 2
    assert got["radius_std"] == pytest.approx((disc - square) / 2) and got["radius_kurtosis"] == pytest.approx(-2)
    assert got["chain_length"] == pytest.approx(math.hypot(60 - 15, 30 - 15), abs=1.5)
    assert got["nuclei_to_tissue"] == pytest.approx((mask == 50).sum() * 50 / ((mask == 200).sum() * 200))
    assert set(run_feature("nuclei", mask=np.full((5, 5), 200, np.uint8)).values()) == {0.0}


def test_traced_components():
    rng = np.random.default_rng(1)
    mask = rng.random((30, 40)) < 0.4
    number = raster.label_components(mask)
    for k, line in raster.traced(mask):
        y, x = np.nonzero(number == k)
        assert line == raster._boundary(number == k, (int(y[0]), int(x[0])))


def test_fit_to_tiles():
    a = np.arange(20 * 13, dtype=np.uint8).reshape(20, 13)
    small = pyramid.fit_to_tiles(a, a, 16)
    assert len(small) == 1 and small[0][0].shape == (16, 16) and (small[0][0][:, 1:14] == a[:16]).all() and (small[0][0][:, 0] == a[:16, 0]).all()
    many = pyramid.fit_to_tiles(a, a, 8)
    assert len(many) == 6 and (many[-1][0] == a[12:, 5:]).all()
    assert (pyramid.fit_to_tiles(a, a, 12, several=2)[0][0] == a[4:16, 0:12]).all()
    half = np.where(np.arange(20)[:, None] < 8, 1, 0) * np.ones((20, 13), int)
    assert len(pyramid.fit_to_tiles(a, half, 8, least_fill=0.1)) == 2


def test_colours(spark):
    import colorsys

    got = spark.range(14).select("id", labels.colour(F.col("id")).alias("c")).collect()
    for r in got[: len(labels.PALETTE)]:
        h, light, s = colorsys.rgb_to_hls(*[v / 255 for v in labels.PALETTE[r["id"]]])
        assert (r["c"]["hue"], r["c"]["lightness"], r["c"]["saturation"]) == (int(h * 360 + 1e-9), pytest.approx(light), pytest.approx(s))
    assert all(0 <= r["c"]["hue"] < 360 for r in got)


def test_pairs_by_quota(spark):
    rng = np.random.default_rng(6)
    cases = spark.createDataFrame([(k, "xyz"[k % 3]) for k in range(120)], "case long, kind string")
    pairs = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 120, (400, 2))] + [(5, 5)], "a long, b long")
    got = tables.balanced_pairs(cases, pairs, "case", "kind", {"x": 1, "y": 1}, 20).collect()
    taken = [c for r in got for c in (r["a"], r["b"])]
    assert len(set(taken)) == len(taken) <= 20 and {r["stratum"] for r in got} == {"x", "y"} and all("xyz"[r["a"] % 3] == r["stratum"] for r in got)
