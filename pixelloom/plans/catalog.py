"""Example queries: every operator on images made of the tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pixelloom.functions.sql import LUMA
from pixelloom.operators import geometry, kernels, looks, points, stats, text, warps, whole
from pixelloom.plans import forms, run
from pixelloom.plans.registry import OPERATORS, Operator
from pixelloom.plans.rel import Rel, SparkRel, Tables
from pixelloom.sources import tables as sources

assert kernels and forms and looks and text and warps and whole  # registered on import

PX = ("image_id", "width", "height", "y", "x", "r", "g", "b", "a")


def rounded(rel: Rel) -> Rel:
    """Pixels in canonical form, channels to six digits. The little that is added keeps decimal halves from hanging on an engine's last bit."""
    return rel.pick(*PX[:5], **{c: f"round({c} + 1.7e-9, 6) + 0e0" for c in "rgba"})


def _inputs(op: Operator, tables: Tables) -> list[Rel]:
    base = sources.px_events(tables)
    if op.inputs == 2:
        return [sources.px_orders(tables), base]
    return [sources.px_orders(tables) if op.category in ("alpha", "mask", "composite", "repair") else base]


def _planned(op: Operator, params: dict) -> Callable[[Tables], Rel]:
    return lambda tables: rounded(op.plan(*_inputs(op, tables), **params))


def _on_spark(op: Operator, params: dict) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        inputs = [r.df for r in _inputs(op, Tables(spark, sf_dir))]
        return rounded(SparkRel(run.apply(inputs[0], op, params, *inputs[1:]))).df

    return query


# reports and compositions of several images


def _reports() -> dict[str, Callable[[Tables], Rel]]:
    events, orders = sources.px_events, sources.px_orders
    six = lambda rel, *cols: rel.pick(*(c for c in rel.cols if c not in cols), **{c: f"round({c}, 6) + 0e0" for c in cols})
    return {
        "histogram": lambda t: stats.histogram(events(t)),
        "histogram_u16": lambda t: stats.histogram(events(t), 65536),
        "statistics": lambda t: six(stats.statistics(events(t)), "low", "high", "mean", "deviation"),
        "metrics": lambda t: six(stats.metrics(events(t), orders(t)), "mae", "rmse", "psnr"),
        "ssim": lambda t: six(stats.ssim(events(t), orders(t)), "ssim"),
        "delta_e": lambda t: six(stats.delta_e(events(t), orders(t)), "delta_e"),
        "delta_e_94": lambda t: six(stats.delta_e_94(events(t), orders(t)), "delta_e"),
        "delta_e_2000": lambda t: six(stats.delta_e_2000(events(t), orders(t)), "delta_e"),
        "prefix_sums": lambda t: rounded(stats.prefix_sums(events(t))),
        "statistics_u16": lambda t: six(stats.statistics_u16(events(t)), "low", "high", "mean", "deviation"),
        "histogram_match": lambda t: rounded(stats.histogram_match(events(t), orders(t))),
        "concat_horizontal": lambda t: rounded(geometry.concat([events(t), geometry.crop(orders(t), 0, 0, 9, 7)], gap=2)),
        "concat_vertical": lambda t: rounded(geometry.concat([events(t), geometry.crop(orders(t), 0, 0, 9, 7)], columns=1, gap=1)),
        "concat_grid": lambda t: rounded(geometry.concat([events(t), geometry.crop(orders(t), 0, 0, 9, 7), orders(t)], columns=2)),
        "composite_over": lambda t: rounded(geometry.composite_over(geometry.crop(orders(t), 2, 2, 8, 8), events(t), 5, -2)),
        "displace": lambda t: rounded(geometry.displace(events(t), orders(t).pick("image_id", "y", "x", map_x="x + (r - 0.5e0) * 9e0", map_y="y + (g - 0.5e0) * 9e0"))),
        "four_point_warp": lambda t: rounded(OPERATORS["perspective_warp"].plan(events(t), **_corners())),
        **{f"aces_output_{d}": lambda t, d=d: rounded(OPERATORS["aces_output"].plan(events(t), display=d)) for d in ("rec709", "p3")},
        **{f"encode_{s}": lambda t, s=s: rounded(OPERATORS["encode_space"].plan(events(t), to=s)) for s in ("lch", "luv", "oklab", "prophoto", "adobe_rgb", "xyz", "cmyk")},
        **{f"decode_{s}": lambda t, s=s: rounded(OPERATORS["decode_space"].plan(OPERATORS["encode_space"].plan(events(t), to=s), of=s)) for s in ("lab", "oklab", "prophoto", "xyz", "cmyk")},
        **{f"blend_{name}": lambda t, m=m: rounded(points.blend_dual(orders(t), events(t), m, 0.75)) for m, name in enumerate(points.MODES)},
        **{f"resize_{m}": lambda t, m=m: rounded(geometry.resize(events(t), 7, 21, m)) for m in ("nearest", "bilinear", "bicubic", "lanczos3")},
        **{f"to_{s}": lambda t, s=s: rounded(events(t).steps(*points.conversion("linear", s))) for s in ("srgb", "acescg", "acescct", "acescc", "aces2065_1")},
        **{f"from_{s}": lambda t, s=s: rounded(events(t).steps(*points.conversion(s, "linear"))) for s in ("acescg", "acescct", "aces2065_1")},
        **{f"idt_{c.replace('-', '_')}": lambda t, c=c: rounded(OPERATORS["camera_idt"].plan(events(t), camera=c)) for c in ("arri-logc3", "arri-logc4", "red-ipp2", "bmd-gen5", "sony-slog3")},
    }


def _corners() -> dict[str, float]:
    found = geometry.homography([(0, 0), (15, 1), (14, 15), (1, 14)], [(0, 0), (15, 0), (15, 15), (0, 15)])
    return dict(zip(("h11", "h12", "h13", "h21", "h22", "h23", "h31", "h32"), found, strict=True))


def foreground(tables: Tables) -> Rel:
    """(image_id, share, pixels): brightened and contrasted images, parted at an automatic threshold of luma."""
    graded = sources.px_events(tables)
    for name, given in (("brightness", {"amount": 0.1}), ("contrast", {"amount": 0.3})):
        op = OPERATORS[name]
        graded = op.plan(graded, **op.bind(given))
    cut = stats.otsu_threshold(graded)
    return cut.agg(["image_id"], share=f"round(avg({LUMA}), 6)", pixels="cast(sum(CASE WHEN r > 0.5e0 THEN 1 ELSE 0 END) as bigint)")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return foreground(Tables(spark, sf_dir)).df


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {"foreground": flagship}
    for op in OPERATORS.values():
        found[op.name] = _on_spark(op, op.bind(op.example))
    for name, build in _reports().items():
        found[name] = lambda spark, sf_dir, build=build: build(Tables(spark, sf_dir)).df
    return found


def oracle_sql() -> dict[str, str]:
    found = {"foreground": foreground(Tables()).sql()}
    for op in OPERATORS.values():
        if op.plan is not None:
            found[op.name] = _planned(op, op.bind(op.example))(Tables()).sql()
    for name, build in _reports().items():
        found[name] = build(Tables()).sql()
    return found
