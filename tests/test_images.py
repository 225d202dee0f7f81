"""Thresholds, objects, distances and basins on pixel tables, against whole arrays; tiles smaller than the objects."""

from collections import deque

import numpy as np
import pytest

from spindrift.operators import images


def table(spark, arrays):
    rows = [(name, int(y), int(x), float(v)) for name, a in arrays.items() for (y, x), v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, "image string, y long, x long, value double").repartition(3)


def filled(mask, diagonal=True):
    """Object numbers by a flood fill in row order."""
    label, n = np.zeros(mask.shape, int), 0
    steps = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0) and (diagonal or not dy * dx)]
    for start in zip(*np.nonzero(mask), strict=True):
        if not label[start]:
            n += 1
            label[start] = n
            wait = deque([start])
            while wait:
                y, x = wait.popleft()
                for dy, dx in steps:
                    at = y + dy, x + dx
                    if 0 <= at[0] < mask.shape[0] and 0 <= at[1] < mask.shape[1] and mask[at] and not label[at]:
                        label[at] = n
                        wait.append(at)
    return label


def test_otsu_separates_two_levels(spark):
    rng = np.random.default_rng(1)
    a = np.where(rng.random((30, 30)) < 0.3, rng.normal(200, 5, (30, 30)), rng.normal(50, 5, (30, 30)))
    got = {r.image: r.threshold for r in images.otsu(table(spark, {"a": a, "flat": np.ones((3, 3))})).collect()}
    assert got["flat"] is None and 65 < got["a"] < 185
    best = max(np.linspace(a.min(), a.max(), 257)[1:-1], key=lambda t: (a < t).sum() * (a >= t).sum() * (a[a < t].mean() - a[a >= t].mean()) ** 2 if (a < t).any() and (a >= t).any() else 0)
    assert ((a >= got["a"]) == (a >= best)).all()
    assert images.foreground(table(spark, {"a": a})).count() == (a >= best).sum()


@pytest.mark.parametrize("diagonal", [True, False])
def test_objects_over_tiles_equal_a_flood_fill(spark, diagonal):
    rng = np.random.default_rng(4)
    a = (rng.random((23, 31)) < 0.45).astype(float)
    snake = np.zeros((20, 20))
    snake[::2] = 1
    snake[1::4, -1] = snake[3::4, 0] = 1
    arrays = {"a": a, "snake": snake}
    mask = table(spark, arrays).where("value > 0")
    got = {name: np.zeros(x.shape, int) for name, x in arrays.items()}
    for r in images.objects(mask, diagonal, tile=7).collect():
        got[r.image][r.y, r.x] = r.object
    for name, x in arrays.items():
        assert (got[name] == filled(x > 0, diagonal)).all()
    assert got["snake"].max() == 1
    if diagonal:
        kept = images.objects(mask.where("image = 'a'"), True, 5, tile=7).collect()
        sizes = np.bincount(filled(a > 0).ravel())[1:]
        assert len(kept) == sizes[sizes >= 5].sum() and images.objects(mask.limit(0)).count() == 0


def test_measures(spark):
    a = np.zeros((12, 14))
    a[2:5, 3:9], a[8, 1], a[9:11, 10:12] = 2.0, 5.0, [[1, 2], [3, 4]]
    got = {r.object: r for r in images.measured(images.objects(table(spark, {"a": a}).where("value > 0"), tile=4)).collect()}
    assert [(got[k].area, got[k].y, got[k].x, got[k].perimeter, got[k]["mean"]) for k in (1, 2, 3)] == [(18, 3.0, 5.5, 18, 2.0), (1, 8.0, 1.0, 4, 5.0), (4, 9.5, 10.5, 8, 2.5)]
    assert (got[1].top, got[1].left, got[1].bottom, got[1].right, got[1].solidity) == (2, 3, 4, 8, 1.0)
    ys, xs = np.nonzero(a == 2.0)
    eigen = np.linalg.eigvalsh(np.cov(np.stack([xs, ys]).astype(float)))
    ys, xs = np.nonzero(filled(a > 0) == 1)
    eigen = np.linalg.eigvalsh(np.cov(np.stack([xs, ys]).astype(float)))
    assert got[1].major == pytest.approx(2 * np.sqrt(eigen[1])) and got[1].minor == pytest.approx(2 * np.sqrt(eigen[0])) and got[2].eccentricity == 0


def test_distances_over_tiles(spark):
    rng = np.random.default_rng(9)
    a = (rng.random((25, 25)) < 0.97).astype(float)
    a[:12, :12] = 1
    got = {(r.y, r.x): r.distance for r in images.distances(table(spark, {"a": a}).where("value > 0"), tile=6).collect()}
    empty = [(y, x) for y in range(-1, 26) for x in range(-1, 26) if not (0 <= y < 25 and 0 <= x < 25) or a[y, x] == 0]
    assert got == {(y, x): min(abs(y - p) + abs(x - q) for p, q in empty) for y, x in zip(*map(lambda v: v.tolist(), np.nonzero(a)), strict=True)}


def test_touching_discs_are_split(spark):
    y, x = np.mgrid[:40, :60]
    discs = ((y - 20) ** 2 + (x - 18) ** 2 <= 144) | ((y - 20) ** 2 + (x - 40) ** 2 <= 144)
    one = (y - 20) ** 2 + (x - 30) ** 2 <= 200
    pixels = table(spark, {"two": discs, "one": one}).where("value > 0")
    assert images.objects(pixels, tile=16).select("image", "object").distinct().count() == 2
    found = {}
    for r in images.watershed(pixels, tile=16).collect():
        found.setdefault(r.image, {}).setdefault(r.basin, []).append(r.x)
    assert sorted(found["two"]) == [1, 2] and sorted(found["one"]) == [1]
    left, right = found["two"][1], found["two"][2]
    assert abs(len(left) - len(right)) < 60 and max(left) <= 31 and min(right) >= 27 and len(left) + len(right) == discs.sum()
