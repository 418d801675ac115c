"""Operators that need statistics of whole images: aggregates per image joined back to its pixels."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pixelloom.functions.sql import LUMA, clamp, each, half_up, lerp, n, whole
from pixelloom.operators.points import to_lab
from pixelloom.plans.registry import metric, plan
from pixelloom.plans.rel import Rel, SparkRel

RUNNING = "(PARTITION BY image_id ORDER BY _bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
BACKWARD = "(PARTITION BY image_id ORDER BY _bin DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
ALL = "(PARTITION BY image_id)"


def tidy(rel: Rel) -> Rel:
    return rel.pick(*(c for c in rel.cols if not c.startswith("_")))


def total(e: str) -> str:
    return f"cast(sum({e}) as bigint)"


def bins(rel: Rel, bin_of: str) -> Rel:
    """(image_id, _bin, _n): how many pixels of each image have each bin."""
    return rel.pick("image_id", _bin=bin_of).agg(["image_id", "_bin"], _n="count(*)")


def floor_bin(c: str) -> str:
    return f"least({whole(f'greatest({c}, 0e0) * 255e0')}, 255)"


def round_bin(e: str) -> str:
    return f"least(greatest(cast({half_up(f'({e}) * 255e0')} as bigint), 0), 255)"


@plan("auto_level", "enhancement")
def auto_level(rel: Rel) -> Rel:
    ends = rel.agg(["image_id"], **{f"_lo{c}": f"min({c})" for c in "rgb"}, **{f"_hi{c}": f"max({c})" for c in "rgb"})
    return tidy(rel.join(ends, ["image_id"]).let(**{c: f"({c} - _lo{c}) / greatest(_hi{c} - _lo{c}, 1e-10)" for c in "rgb"}))


@plan("white_balance_gray_world", "color")
def white_balance_gray_world(rel: Rel) -> Rel:
    means = rel.agg(["image_id"], **{f"_m{c}": f"avg({c})" for c in "rgb"}).let(_m="(_mr + _mg + _mb) / 3e0")
    return tidy(rel.join(means, ["image_id"]).let(**{c: f"CASE WHEN _m{c} > 1e-10 THEN {c} * _m / nullif(_m{c}, 0e0) ELSE {c} END" for c in "rgb"}))


@plan("match_color", "color", {"target_mean_g": 0.3, "strength": 0.7}, target_mean_r=(0.5, 0.0, 1.0), target_mean_g=(0.5, 0.0, 1.0), target_mean_b=(0.5, 0.0, 1.0), target_std=(0.15, 0.01, 0.5), strength=(1.0, 0.0, 1.0))
def match_color(rel: Rel, target_std: float, strength: float, **means: float) -> Rel:
    found = rel.agg(["image_id"], **{f"_m{c}": f"avg({c})" for c in "rgb"}, **{f"_s{c}": f"stddev_pop({c})" for c in "rgb"})
    moved = {c: f"(({c} - _m{c}) * {n(target_std)} / greatest(_s{c}, 1e-3) + {n(means['target_mean_' + c])})" for c in "rgb"}
    return tidy(rel.join(found, ["image_id"]).let(**{c: clamp(lerp(c, moved[c], n(strength))) for c in "rgb"}))


@plan("equalize", "enhancement")
def equalize(rel: Rel) -> Rel:
    out = rel.let(**{f"_b{c}": floor_bin(c) for c in "rgb"})
    for c in "rgb":
        cdf = bins(rel, floor_bin(c)).let(_cum=f"cast(sum(_n) OVER {RUNNING} as bigint)", _all=f"cast(sum(_n) OVER {ALL} as bigint)")
        cdf = cdf.let(_low=f"min(_cum) OVER {ALL}").pick("image_id", **{f"_b{c}": "_bin", f"_v{c}": "CASE WHEN _all > _low THEN (_cum - _low) * 1e0 / nullif(_all - _low, 0) ELSE NULL END"})
        out = out.join(cdf, ["image_id", f"_b{c}"])
    return tidy(out.let(**{c: f"coalesce(_v{c}, {c})" for c in "rgb"}))


@plan("normalize", "enhancement", {"black_clip": 0.05}, black_clip=(0.02, 0.0, 0.5), white_clip=(0.01, 0.0, 0.5))
def normalize(rel: Rel, black_clip: float, white_clip: float) -> Rel:
    out = rel
    for c in "rgb":
        cum = bins(rel, floor_bin(c)).let(_up=f"cast(sum(_n) OVER {RUNNING} as bigint)", _down=f"cast(sum(_n) OVER {BACKWARD} as bigint)", _all=f"cast(sum(_n) OVER {ALL} as bigint)")
        ends = cum.agg(
            ["image_id"],
            # a threshold of zero is met by the first bin that is looked at
            **{
                f"_k{c}": f"CASE WHEN floor(max(_all) * {n(black_clip)}) <= 0 THEN 0 ELSE min(CASE WHEN _up >= floor(_all * {n(black_clip)}) THEN _bin END) END",
                f"_w{c}": f"CASE WHEN floor(max(_all) * {n(white_clip)}) <= 0 THEN 255 ELSE max(CASE WHEN _down >= floor(_all * {n(white_clip)}) THEN _bin END) END",
            },
        )
        out = out.join(ends, ["image_id"])
    return tidy(out.let(**{c: f"CASE WHEN _w{c} > _k{c} THEN ({c} - _k{c} / 255e0) / nullif((_w{c} - _k{c}) / 255e0, 0e0) ELSE {c} END" for c in "rgb"}))


@plan("contrast_stretch", "statistics", {"black_pct": 0.05, "white_pct": 0.1}, black_pct=(0.02, 0.0, 0.5), white_pct=(0.01, 0.0, 0.5))
def contrast_stretch(rel: Rel, black_pct: float, white_pct: float) -> Rel:
    """normalize with results clipped to [0, 1]."""
    return normalize(rel, black_pct, white_pct).let(**each(clamp("{v}")))


def _binary(rel: Rel, cut: Rel) -> Rel:
    """White where luma reaches the image's _cut."""
    return tidy(rel.join(cut, ["image_id"]).let(**each(f"CASE WHEN {LUMA} >= (_cut + 0.5e0) / 255e0 THEN 1e0 ELSE 0e0 END")))


def otsu_cut(rel: Rel) -> Rel:
    """(image_id, _cut): the bin of luma that parts an image with most variance between classes, the first on ties."""
    levels = bins(rel, round_bin(LUMA)).let(_w=f"cast(sum(_n) OVER {RUNNING} as double)", _s=f"cast(sum(_n * _bin) OVER {RUNNING} as double)", _all=f"cast(sum(_n) OVER {ALL} as double)", _sum=f"cast(sum(_n * _bin) OVER {ALL} as double)")
    spread = levels.let(_var="CASE WHEN _all > _w THEN _w * (_all - _w) * (_s / _w - (_sum - _s) / nullif(_all - _w, 0e0)) * (_s / _w - (_sum - _s) / nullif(_all - _w, 0e0)) ELSE 0e0 END")
    ranked = spread.let(_rank="row_number() OVER (PARTITION BY image_id ORDER BY _var DESC, _bin)")
    return ranked.where("_rank = 1").pick("image_id", _cut="CASE WHEN _var > 0e0 THEN _bin ELSE 0 END")


@plan("otsu_threshold", "adjustment")
def otsu_threshold(rel: Rel) -> Rel:
    return _binary(rel, otsu_cut(rel))


@plan("triangle_threshold", "adjustment")
def triangle_threshold(rel: Rel) -> Rel:
    """The level farthest from the line between a histogram's peak and its longer tail."""
    levels = bins(rel, round_bin(LUMA))
    peak = levels.let(_rank="row_number() OVER (PARTITION BY image_id ORDER BY _n DESC, _bin)").where("_rank = 1").pick("image_id", _peak="_bin", _top="_n")
    ends = levels.agg(["image_id"], _left="greatest(min(_bin) - 1, 0)", _right="least(max(_bin) + 1, 255)")
    frame = peak.join(ends, ["image_id"]).let(_flip="CASE WHEN _peak - _left < _right - _peak THEN 1 ELSE 0 END")
    frame = frame.let(_from="CASE WHEN _flip = 1 THEN 255 - _right ELSE _left END", _to="CASE WHEN _flip = 1 THEN 255 - _peak ELSE _peak END")
    # every level between, also those without pixels
    walk = frame.where("_to > _from").series("_i", "_from + 1", "_to").let(_bin="CASE WHEN _flip = 1 THEN 255 - _i ELSE _i END")
    far = walk.join(levels, ["image_id", "_bin"], "left").let(_d="_top * _i + (_from - _to) * coalesce(_n, 0)").where("_d > 0")
    best = far.let(_rank="row_number() OVER (PARTITION BY image_id ORDER BY _d DESC, _i)").where("_rank = 1").pick("image_id", "_i")
    cut = frame.join(best, ["image_id"], "left").let(_t="coalesce(_i, _from) - 1").pick("image_id", _cut="CASE WHEN _flip = 1 THEN 255 - _t ELSE _t END")
    return _binary(rel, cut)


@plan("pixelate", "effect", {"block_size": 5}, block_size=(8, 1, 100))
def pixelate(rel: Rel, block_size: int) -> Rel:
    cell = {"_by": whole(f"y / {n(block_size)}"), "_bx": whole(f"x / {n(block_size)}")}
    keyed = rel.let(**cell)
    means = keyed.agg(["image_id", "_by", "_bx"], **{f"_m{c}": f"avg({c})" for c in "rgb"})
    return tidy(keyed.join(means, ["image_id", "_by", "_bx"]).let(**{c: f"_m{c}" for c in "rgb"}))


# reports: one row for each image, channel or bin


def _channels(rel: Rel) -> Rel:
    """(image_id, channel, v)"""
    parts = [rel.pick("image_id", channel=f"cast({k} as bigint)", v=c) for k, c in enumerate("rgba")]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def histogram(rel: Rel, levels: int = 256) -> Rel:
    """(image_id, channel, bin, pixels), channels 0 to 3 being r, g, b, a."""
    top = levels - 1
    return _channels(rel).pick("image_id", "channel", bin=f"least(greatest(cast({half_up(f'v * {n(top)}')} as bigint), 0), {top})").agg(["image_id", "channel", "bin"], pixels="count(*)")


def statistics(rel: Rel) -> Rel:
    """(image_id, channel, low, high, mean, deviation)"""
    return _channels(rel).agg(["image_id", "channel"], low="min(v)", high="max(v)", mean="avg(v)", deviation="stddev_pop(v)")


def histogram_match(source: Rel, target: Rel) -> Rel:
    """Pixels of source with each channel's levels moved to the target's levels of the nearest cumulative share, the lowest on ties."""
    if isinstance(source, SparkRel):
        return _matched(source, target)
    out = source.let(**{f"_b{c}": round_bin(c) for c in "rgb"})
    for c in "rgb":
        sides = []
        for rel in (source, target):
            share = bins(rel, round_bin(c)).let(_cum=f"cast(sum(_n) OVER {RUNNING} as bigint)", _all=f"cast(sum(_n) OVER {ALL} as bigint)")
            # all 256 levels have a cumulative share: that of the last level at or below
            grid = share.agg(["image_id"], _all="max(_all)").series("_bin", "0", "255")
            steps = grid.join(share.pick("image_id", "_bin", "_cum"), ["image_id", "_bin"], "left")
            sides.append(steps.let(_share=f"coalesce(max(_cum) OVER {RUNNING}, 0) * 1e0 / _all").pick("image_id", "_bin", "_share"))
        pairs = sides[0].where("_share > 0e0").rename(_src="_bin", _a="_share").join(sides[1].rename(_dst="_bin", _b="_share"), ["image_id"])
        best = pairs.let(_rank="row_number() OVER (PARTITION BY image_id, _src ORDER BY abs(_a - _b), _dst)").where("_rank = 1")
        out = out.join(best.pick("image_id", **{f"_b{c}": "_src", f"_v{c}": "_dst / 255e0"}), ["image_id", f"_b{c}"])
    return tidy(out.let(**{c: f"_v{c}" for c in "rgb"}))


#: Pixels of one image whose levels are counted together, so one huge image doesn't become one task.
BLOCK = 65536
#: Parts in which levels are counted, at least. Few bytes arrive for many counts, so they must not be merged by their bytes.
PARTS = 128


def _matched(source: SparkRel, target: SparkRel) -> SparkRel:
    """histogram_match without its pairs of levels: pixels go to their images once to be counted and once to be changed, and all that is held for an image is two histograms."""
    parts = max(int(source.df.sparkSession.conf.get("spark.sql.shuffle.partitions")), PARTS)
    sides = []
    for side, rel in enumerate((source, target)):
        packed = " + ".join(f"{256**k} * {round_bin(c)}" for k, c in enumerate("rgb"))
        sides.append(rel.pick("image_id", _block=whole(f"(y * width + x) / {BLOCK}e0"), _side=f"cast({3 * side} as bigint)", _packed=packed))
    each_level = ", ".join(f"256 * (_side + {k}) + (shiftright(_packed, {8 * k}) & 255)" for k in range(3))
    levels = SparkRel(sides[0].union(sides[1]).df.repartition(parts, "image_id", "_block")).pick("image_id", "_block", _bin=f"explode(array({each_level}))")
    blocks = levels.agg(["image_id", "_block", "_bin"], _n="count(*)").drop("_block")
    found = SparkRel(blocks.df.repartition(parts, "image_id")).agg(["image_id", "_bin"], _n="sum(_n)").agg(["image_id"], _bins="collect_list(_bin)", _counts="collect_list(_n)")
    tables = SparkRel(found.df.mapInArrow(_level_tables, "image_id long, _to array<smallint>"))
    moved = {c: f"_to[cast({256 * k} + {round_bin(c)} as int)] / 255e0" for k, c in enumerate("rgb")}
    return tidy(source.join(tables, ["image_id"]).let(**moved))


def nearest_levels(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each level the lowest one whose share of pixels up to it in the target is nearest to the source's."""
    a, b = (np.cumsum(v) * 1.0 / v.sum() for v in (source, target))
    return np.abs(a[:, None] - b).argmin(1)


def _level_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, tables = [], []
        for i, bins, counts in zip(*(batch.column(c) for c in ("image_id", "_bins", "_counts")), strict=True):
            both = np.zeros(6 * 256, np.int64)
            both[bins.values.to_numpy()] = counts.values.to_numpy()
            source, target = both.reshape(2, 3, 256)
            if source.any() and target.any():
                ids.append(i.as_py())
                tables.append(np.concatenate([nearest_levels(*pair) for pair in zip(source, target, strict=True)]))
        flat = np.concatenate(tables).astype(np.int16) if tables else np.empty(0, np.int16)
        to = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * 768), pa.array(flat))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), to], ["image_id", "_to"])


def _compared(a: Rel, b: Rel) -> Rel:
    return a.pick("image_id", "y", "x", "r", "g", "b").join(b.pick("image_id", "y", "x", _r="r", _g="g", _b="b"), ["image_id", "y", "x"])


@metric("metrics")
def metrics(a: Rel, b: Rel) -> Rel:
    """(image_id, mae, rmse, psnr) over 8-bit levels of r, g, b; psnr is null for equal images (infinite)."""
    level = lambda c: half_up(clamp(c) + " * 255e0")
    diff = _compared(a, b).let(**{f"_d{c}": f"{level(c)} - {level('_' + c)}" for c in "rgb"})
    sums = diff.agg(["image_id"], mae="avg(abs(_dr) + abs(_dg) + abs(_db)) / 3e0", _mse="avg(_dr * _dr + _dg * _dg + _db * _db) / 3e0")
    return sums.pick("image_id", "mae", rmse="sqrt(_mse)", psnr="CASE WHEN _mse > 0e0 THEN 10e0 * ln(65025e0 / nullif(_mse, 0e0)) / ln(10e0) ELSE NULL END")


def _labs(a: Rel, b: Rel) -> Rel:
    """(image_id, y, x, l1, a1, b1, l2, a2, b2): both images' pixels in Lab."""
    both = _compared(a, b).steps(*to_lab()).let(l1="_ll", a1="_aa", b1="_bb", r="_r", g="_g", b="_b").steps(*to_lab())
    return both.pick("image_id", "y", "x", "l1", "a1", "b1", l2="_ll", a2="_aa", b2="_bb")


@metric("delta_e")
def delta_e(a: Rel, b: Rel) -> Rel:
    """(image_id, delta_e): mean distance in Lab."""
    return _labs(a, b).agg(["image_id"], delta_e="avg(sqrt((l1 - l2) * (l1 - l2) + (a1 - a2) * (a1 - a2) + (b1 - b2) * (b1 - b2)))")


@metric("delta_e_94")
def delta_e_94(a: Rel, b: Rel) -> Rel:
    """(image_id, delta_e): mean CIE 1994 difference, for graphic arts."""
    from pixelloom.operators.looks import delta_e_94 as difference

    return _labs(a, b).agg(["image_id"], delta_e=f"avg({difference('l1', 'a1', 'b1', 'l2', 'a2', 'b2')})")


@metric("delta_e_2000")
def delta_e_2000(a: Rel, b: Rel) -> Rel:
    """(image_id, delta_e): mean CIEDE2000 difference."""
    seventh = lambda e: f"sqrt(pow({e}, 7e0) / (pow({e}, 7e0) + {n(25.0**7)}))"
    out = _labs(a, b).let(_cm="(sqrt(a1 * a1 + b1 * b1) + sqrt(a2 * a2 + b2 * b2)) / 2e0").let(_g=f"1e0 + 0.5e0 * (1e0 - {seventh('_cm')})")
    out = out.let(a1="a1 * _g", a2="a2 * _g").let(**{f"c{i}": f"sqrt(a{i} * a{i} + b{i} * b{i})" for i in (1, 2)})
    out = out.let(**{f"h{i}": f"CASE WHEN atan2(b{i}, a{i}) < 0e0 THEN degrees(atan2(b{i}, a{i})) + 360e0 ELSE degrees(atan2(b{i}, a{i})) END" for i in (1, 2)})
    turn = "CASE WHEN abs(h2 - h1) <= 180e0 THEN h2 - h1 WHEN h2 > h1 THEN h2 - h1 - 360e0 ELSE h2 - h1 + 360e0 END"
    mean = "CASE WHEN abs(h1 - h2) <= 180e0 THEN (h1 + h2) / 2e0 WHEN h1 + h2 < 360e0 THEN (h1 + h2 + 360e0) / 2e0 ELSE (h1 + h2 - 360e0) / 2e0 END"
    out = out.settled().let(_turn=f"CASE WHEN c1 * c2 = 0e0 THEN 0e0 ELSE {turn} END", _hm=f"CASE WHEN c1 * c2 = 0e0 THEN h1 + h2 ELSE {mean} END", _lm="(l1 + l2) / 2e0 - 50e0", _cm="(c1 + c2) / 2e0")
    out = out.settled()
    cosine = lambda k, shift: f"cos(radians({n(k)} * _hm + {n(shift)}))"
    out = out.let(_t=f"1e0 - 0.17e0 * {cosine(1, -30)} + 0.24e0 * {cosine(2, 0)} + 0.32e0 * {cosine(3, 6)} - 0.2e0 * {cosine(4, -63)}")
    out = out.let(
        _l="(l2 - l1) / (1e0 + 0.015e0 * _lm * _lm / sqrt(20e0 + _lm * _lm))",
        _c="(c2 - c1) / (1e0 + 0.045e0 * _cm)",
        _h="2e0 * sqrt(c1 * c2) * sin(radians(_turn) / 2e0) / (1e0 + 0.015e0 * _cm * _t)",
        _r=f"-2e0 * {seventh('_cm')} * sin(radians(60e0 * exp(-(_hm - 275e0) * (_hm - 275e0) / 625e0)))",
    )
    return out.agg(["image_id"], delta_e="avg(sqrt(greatest(_l * _l + _c * _c + _h * _h + _r * _c * _h, 0e0)))")


def prefix_sums(rel: Rel) -> Rel:
    """Each channel's sum over all pixels above and to the left, its own included (a summed-area table)."""
    across = rel.let(**{f"_{c}": f"sum({c}) OVER (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)" for c in "rgba"})
    down = across.let(**{c: f"sum(_{c}) OVER (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)" for c in "rgba"})
    return down.drop("_r", "_g", "_b", "_a")


def statistics_u16(rel: Rel) -> Rel:
    """(image_id, channel, low, high, mean, deviation) of 16-bit levels."""
    return statistics(rel.let(**{c: half_up(clamp(c) + " * 65535e0") for c in "rgba"}))


@metric("ssim")
def ssim(a: Rel, b: Rel, size: int = 11, sigma: float = 1.5) -> Rel:
    """(image_id, ssim): structural similarity of 8-bit levels, by a Gaussian window that lies inside the image, mean over places and channels."""
    r = size // 2
    weights = [math.exp(-((i - r) ** 2) / (2 * sigma * sigma)) for i in range(size)]
    taps = [(i - r, w / sum(weights)) for i, w in enumerate(weights)]
    level = lambda c: half_up(clamp(c) + " * 255e0")
    out = _compared(a, b).join(a.agg(["image_id"], _w="max(width)", _h="max(height)"), ["image_id"])
    planes = {}
    for c in "rgb":
        u, v = level(c), level("_" + c)
        planes |= {f"u{c}": u, f"v{c}": v, f"uu{c}": f"{u} * {u}", f"vv{c}": f"{v} * {v}", f"uv{c}": f"{u} * {v}"}
    out = out.pick("image_id", "y", "x", "_w", "_h", **planes)
    for axis, limit in (("x", "_w"), ("y", "_h")):
        spread = out.join(out.values(["_d", "_k"], taps), []).let(**{axis: f"{axis} + _d"}).where(f"{axis} >= {r} AND {axis} < {limit} - {r}")
        out = spread.agg(["image_id", "y", "x", "_w", "_h"], **{k: f"sum(_k * {k})" for k in planes})
    c1, c2 = n((0.01 * 255) ** 2), n((0.03 * 255) ** 2)
    index = lambda c: f"(2e0 * u{c} * v{c} + {c1}) * (2e0 * (uv{c} - u{c} * v{c}) + {c2}) / ((u{c} * u{c} + v{c} * v{c} + {c1}) * (uu{c} - u{c} * u{c} + vv{c} - v{c} * v{c} + {c2}))"
    return out.agg(["image_id"], ssim="avg((" + " + ".join(index(c) for c in "rgb") + ") / 3e0)")
