"""Bicubic samples come from tiles: equal to the plain sum over 16 taps, wherever tiles end."""

import math

from screentone.operators import grid


def weight(t):
    return [0.5 * (-t + 2 * t * t - t * t * t), 0.5 * (2 - 5 * t * t + 3 * t * t * t), 0.5 * (t + 4 * t * t - 3 * t * t * t), 0.5 * (-t * t + t * t * t)]


def test_tiles_give_the_plain_sum(spark):
    cols, rows = 21, 13
    # one tone is missing, one is null
    tones = {(c, r): None if (c, r) == (9, 9) else (c * 7 + r * 5) % 11 / 10 for c in range(cols) for r in range(rows) if (c, r) != (4, 4)}
    points = [(k, k * 0.37 - 1.5, k * 0.23 - 1.5) for k in range(70)]
    want = {}
    for k, u, v in points:
        x, y = math.floor(u - 0.5), math.floor(v - 0.5)
        taps = [(a * b, tones.get((min(cols - 1, max(0, x + i - 1)), min(rows - 1, max(0, y + j - 1))))) for i, a in enumerate(weight(u - 0.5 - x)) for j, b in enumerate(weight(v - 0.5 - y))]
        want[k] = min(1, max(0, sum(math.floor(w * t * 1e12 + 0.5) for w, t in taps if t is not None) / 1e12))
    t = spark.createDataFrame([(1, c, r, v) for (c, r), v in tones.items()], "image_id long, col int, row int, value double")
    p = spark.createDataFrame([(1, k, cols, rows, u, v) for k, u, v in points], "image_id long, point_id long, cols int, rows int, u double, v double")
    got = grid.sample_bicubic(p, t)
    assert {r["point_id"]: r["value"] for r in got.collect()} == want
    # a point meets one tile, so one row of it is shuffled, not one of each tap
    tiles = grid.tone_tiles(t)
    assert tiles.select("image_id", "tx", "ty").distinct().count() == tiles.count() == 6
