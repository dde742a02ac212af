"""Thresholds from histograms and replacement of tile models."""

import numpy as np
import pytest

from netloom.plans import fields


def bump(levels, centre, spread, height):
    return height * np.exp(-0.5 * ((np.arange(levels) - centre) / spread) ** 2)


def test_minimum_between_background_and_signal():
    counts = np.round(bump(200, 40, 6, 10_000) + bump(200, 130, 15, 800) + 20)
    threshold, peak, width, tail = fields.histogram_threshold(counts, 5, 255)
    assert peak == 45 and width == pytest.approx(2.355 * 6, rel=0.05) and tail == 45 + round(width)
    assert 70 <= threshold <= 105


def test_no_minimum_means_two_widths():
    counts = np.concatenate([np.arange(0, 100, 10), np.arange(100, 0, -2)]).astype(float)
    threshold, peak, width, tail = fields.histogram_threshold(counts, 0, 255)
    assert (peak, width) == (10, 5 + 25) and tail == 40 and threshold == 40  # two widths lie behind the last level


def test_the_highest_peak_is_not_the_first():
    counts = np.round(bump(200, 30, 4, 500) + bump(200, 100, 10, 2000) + 3)
    assert fields.histogram_threshold(counts, 0, 255)[1] == 100  # (127.5 - 100) / 24 is less than (127.5 - 30) / 9


def test_peaks_too_near_or_too_low_don_t_count():
    y = np.zeros(60)
    y[[10, 14, 30, 50]] = [100, 90, 40, 0.01]
    assert fields._peaks(y).tolist() == [10, 14, 30, 50]
    threshold, peak, width, tail = fields.histogram_threshold(y, 0, 255)
    assert (peak, width, tail) == (10, 1.0, 11) and threshold > 11
    flat = np.array([0, 1, 3, 3, 3, 1, 0, 2, 2.0])
    assert fields._peaks(flat).tolist() == [2]
    assert fields._width(np.array([0, 2, 4, 3, 3.5, 0]), 4, False) == pytest.approx(0.5 + 0.25 / 3.5, abs=1e-9)


def test_no_peak():
    assert fields.histogram_threshold(np.array([5.0, 4, 3]), 7, 255) == (7, None, None, None)


def test_blocks(spark):
    counts = {b: np.round(bump(200, 40, s, 90) + bump(200, 140, 10, 20)).astype(int) for b, s in ((1, 3), (2, 6))}
    rows = [(b, v) for b, c in counts.items() for v, n in enumerate(c.tolist()) for _ in range(n)] + [(3, 9), (None, 10), (1, None), (1, 9999)]
    found = {r.block: r for r in fields.block_thresholds(spark.createDataFrame(rows, "block long, level long"), "block", "level", 255).collect()}
    assert set(found) == {1, 2, 3, None} and found[3].peak is None and found[3].threshold == 9
    assert abs(found[1].peak - 40) <= 2 and abs(found[2].peak - 40) <= 4 and found[1].width < found[2].width
    assert [found[b].threshold for b in (1, 2)] == [50, 60]  # where the empty valley between begins


def test_models_of_reliable_tiles(spark):
    tiles = spark.createDataFrame([(1, 0, 0, 0), (2, 1, 0, 0), (3, 5, 0, 0), (4, 1, 0, 1), (5, 2, 0, 0)], "tile long, x long, y long, z long")
    models = spark.createDataFrame([(1, 1.0, 2.0), (2, 9.0, 9.0), (3, 1.01, 2.0), (4, 1.0, 2.02)], "tile long, a double, b double")
    found = {r.tile: (r.reliable, r.source, r.a) for r in fields.reliable_models(tiles, models, ["a", "b"], most=1.0).collect()}
    assert found == {1: (True, 1, 1.0), 2: (False, 1, 1.0), 3: (True, 3, 1.01), 4: (True, 4, 1.0), 5: (False, 1, 1.0)}
