"""Raw layouts by values, parameters bound to analyses, the audit, tables of operators, and registration by users."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.functions import matrices
from pixelloom.operators import tables
from pixelloom.plans import registry, run, staged
from pixelloom.plans.pipeline import Pipeline, crop_boxes
from pixelloom.plans.registry import METRICS, OPERATORS
from pixelloom.plans.staged import Bound
from pixelloom.sources import codecs, images, layouts
from pixelloom.sources.looks import Lut


def test_twenty_layouts_come_back():
    rng = np.random.default_rng(1)
    gray = np.repeat(rng.integers(0, 256, (5, 7, 1)) / 255, 3, -1)
    img = np.concatenate([gray, np.ones((5, 7, 1))], -1)
    assert len(layouts.LAYOUTS) == 20
    for name in layouts.LAYOUTS:
        data = layouts.from_rgba(img, name)
        assert len(data) == layouts.size_of(name, 7, 5)
        # gray images keep their luma in all of them, but for rounding
        assert np.abs(layouts.to_rgba(data, 7, 5, name) - img).max() < 0.01, name
        with pytest.raises(ValueError):
            layouts.to_rgba(data[:-1], 7, 5, name)
    colours = rng.integers(0, 256, (5, 7, 4)) / 255
    for name in ("rgba8", "bgra8", "rgba16", "rgba16f", "rgba32f"):
        assert np.abs(layouts.to_rgba(layouts.from_rgba(colours, name), 7, 5, name) - colours).max() < 0.001
    assert np.abs(layouts.to_rgba(layouts.from_rgba(colours, "cmyka8"), 7, 5, "cmyka8") - colours).max() < 0.01
    assert np.abs(layouts.to_rgba(layouts.from_rgba(colours, "yuv444p"), 7, 5, "yuv444p")[..., :3] - colours[..., :3]).max() < 0.01


def test_conversions_by_value():
    change = lambda data, a, b, n=1: layouts.converted(bytes(data), n, 1, a, b)
    assert change([10, 20, 30], "rgb8", "rgba8") == bytes([10, 20, 30, 255])
    assert change([10, 20, 30, 40], "bgra8", "rgba8") == bytes([30, 20, 10, 40])
    assert change([10, 20, 30], "rgb8", "gray8") == bytes([77 * 10 + 150 * 20 + 29 * 30 + 128 >> 8])
    assert change([10, 20, 30], "rgb8", "rgb16") == np.array([2570, 5140, 7710], "<u2").tobytes()
    sixteen = np.array([0, 128, 129, 65535], "<u2")
    assert change(sixteen.tobytes(), "gray16", "gray8", 4) == bytes((int(v) + 128) // 257 for v in sixteen)
    # samples and channels both change: through 8 bits
    fine = np.array([1000, 2000, 3000], "<u2")
    eight = [(int(v) + 128) // 257 for v in fine]
    luma = 77 * eight[0] + 150 * eight[1] + 29 * eight[2] + 128 >> 8
    assert change(fine.tobytes(), "rgb16", "gray8") == bytes([luma])
    assert change(fine.tobytes(), "rgb16", "gray16") == np.array([luma * 257], "<u2").tobytes()
    assert np.allclose(np.frombuffer(change(fine.tobytes(), "rgb16", "rgba32f"), "<f4"), [*(fine / 65535), 1])
    wide = np.array([0.25, 0.5, 0.75, 1], "<f4")
    assert change(wide.tobytes(), "rgba32f", "gray8") == bytes([int((0.2126 * 0.25 + 0.7152 * 0.5 + 0.0722 * 0.75) * 255 + 0.5)])
    assert change(np.array([0.5, -1, 2, 1], "<f2").tobytes(), "rgba16f", "rgba8") == bytes([128, 0, 255, 255])
    assert np.allclose(np.frombuffer(change([51, 0, 255, 102], "cmyk8", "rgba32f"), "<f4"), [0.8 * 0.6, 0.6, 0, 1])


def test_chroma_is_averaged():
    img = np.zeros((2, 2, 4))
    img[0, 0, 0] = img[1, 1, 2] = 1.0
    data = layouts.from_rgba(img, "yuv420p")
    u, v = (img[..., :3] @ layouts.BT601.T).mean((0, 1))[1:] * 255 + 128
    assert list(data[4:]) == [int(u + 0.5), int(v + 0.5)]
    assert layouts.from_rgba(img, "nv12") == data
    assert layouts.size_of("yuv420p", 3, 5) == 15 + 2 * 2 * 3 and layouts.size_of("yuv422p", 3, 5) == 15 + 2 * 2 * 5


def test_layouts_on_rows(spark):
    rows = [(1, 2, 1, bytearray([1, 2, 3, 4, 5, 6])), (2, 1, 1, None), (3, 4, 4, bytearray(3))]
    df = spark.createDataFrame(rows, "image_id long, width long, height long, content binary")
    got = {r.image_id: r.content for r in layouts.convert_format(df, "rgb8", "bgr8").collect()}
    assert bytes(got[1]) == bytes([3, 2, 1, 6, 5, 4]) and got[2] is None and got[3] is None
    assert layouts.convert_format(df.limit(0), "rgb8", "gray8").collect() == []
    with pytest.raises(ValueError):
        layouts.convert_format(df, "rgb8", "rgb9")
    ok = df.where("image_id = 1")
    for name in ("bgr8", "gray16", "rgb16f", "nv12"):
        again = images.to_raw(images.from_raw(layouts.convert_format(ok, "rgb8", name), name), name).collect()[0]
        want = layouts.converted(bytes(rows[0][3]), 2, 1, "rgb8", name)
        assert np.abs(np.frombuffer(bytes(again.content), "u1").astype(int) - np.frombuffer(want, "u1")).max() <= (1 if name in ("bgr8", "nv12") else 0)


@pytest.fixture(scope="module")
def pictures(spark):
    rng = np.random.default_rng(3)
    out = []
    for i, (h, w) in enumerate([(9, 12), (14, 8), (6, 6)]):
        v = rng.random((h, w, 4), np.float32)
        v[..., 3] = 1
        out.append((i, w, h, bytearray(run.packed(v))))
    return spark.createDataFrame(out, "image_id long, width long, height long, data binary")


def arrays(df):
    return {r.image_id: run.unpacked(bytes(r.data), r.width, r.height) for r in df.collect()}


def boxes(df):
    return crop_boxes(df).withColumnsRenamed({"w": "width", "h": "height"})


def darkness(df):
    """(image_id, value): what the mean red lacks of one half; no row for image 2."""
    return run.to_pixels(df).where("image_id < 2").groupBy("image_id").agg((0.5 - F.avg("r")).alias("value"))


def test_each_image_has_its_own_parameters(pictures):
    chain = Pipeline(pictures).brightness(amount=Bound(darkness))
    got, before = arrays(chain.images()), arrays(pictures)
    for i in (0, 1):
        alone = Pipeline(pictures.where(f"image_id = {i}")).brightness(amount=float(0.5 - before[i][..., 0].mean()))
        # the conversions that the operator asks for stand around it here, too
        assert np.abs(got[i] - arrays(alone.images())[i]).max() < 1e-5
    # image 2 has no row; it goes to ACEScct and back by matrices of six digits
    assert np.abs(got[2] - before[2]).max() < 5e-5


def test_fields_of_a_box(pictures):
    steps = {p: Bound(boxes, f) for p, f in (("x", "x"), ("y", "y"), ("w", "width"), ("h", "height"))}
    got = arrays(Pipeline(pictures).invert().crop(**steps).images())
    for r in boxes(Pipeline(pictures).invert().images()).collect():
        v = 1 - arrays(pictures)[r.image_id][r.y : r.y + r.height, r.x : r.x + r.width]
        assert np.abs(got[r.image_id][..., :3] - v[..., :3]).max() < 1e-6
    # pixels of rows give the same
    again = arrays(Pipeline(run.to_pixels(pictures)).invert().crop(**steps).images())
    assert all(np.abs(again[i] - v).max() < 1e-6 for i, v in got.items())


def test_bindings_are_checked(pictures):
    for given in ({"amont": Bound(darkness)}, {"source": Bound(darkness)}):
        with pytest.raises(TypeError):
            Pipeline(pictures).then("brightness" if "amont" in given else "convert_color_space", **given)
    with pytest.raises(ValueError):
        Bound(darkness, "colour")
    p = Pipeline(pictures)
    two = p.brightness(amount=Bound(darkness)).contrast(amount=Bound(darkness)).exposure(ev=Bound(darkness, after=0))
    assert two.waves() == [[0, 2], [1]]
    with pytest.raises(ValueError):
        p.brightness(amount=Bound(darkness, after=1)).frame()
    assert p.brightness(amount=Bound(darkness)).hash() != p.brightness(amount=Bound(boxes, "x")).hash()


def test_audit(pictures):
    chain = Pipeline(pictures).brightness(amount=0.1).view_transform(view="srgb").pixelate(block_size=2)
    found = chain.audit()
    assert [found.count(x) for x in staged.LEVELS] == [1, 1, 0, 1] and not found.safe
    assert [(i, name) for i, name, _ in found.violations] == [(2, "pixelate")] and "pixelate" in str(found)
    assert Pipeline(pictures).brightness(amount=0.1).audit().safe
    with pytest.raises(ValueError, match="pixelate"):
        Pipeline(pictures, chain.steps, strict=True).frame()


@pytest.mark.parametrize("preset", ["idt-rec709", "idt-rec2020", "idt-p3"])
def test_inputs_without_a_curve_are_taken_as_linear(preset):
    """These spaces pass through unchanged before the matrix."""
    img = np.random.default_rng(1).random((2, 3, 4))
    got = OPERATORS["color_transform"].kernel(img, preset=preset)
    assert np.abs(got[..., :3] - img[..., :3] @ matrices.SRGB_TO_ACESCG.T).max() < 1e-12
    curved = OPERATORS["color_transform"].kernel(img, preset="idt-srgb")
    assert np.abs(curved[..., :3] - codecs.to_linear(img[..., :3]) @ matrices.SRGB_TO_ACESCG.T).max() < 1e-9


def test_tables_of_levels(pictures):
    invert, post = tables.level_table("invert"), tables.level_table("posterize", levels=4)
    assert (invert == 255 - np.arange(256)).all()
    assert (tables.composed(invert, post) == post[255 - np.arange(256)]).all()
    assert (tables.level_table("invert", 16) == 65535 - np.arange(65536)).all()
    with pytest.raises(ValueError):
        tables.composed(invert, tables.level_table("invert", 16))
    got = arrays(run.to_images(tables.with_levels(run.to_pixels(pictures), invert)))
    for i, v in arrays(pictures).items():
        assert np.abs(got[i][..., :3] - (255 - np.floor(v[..., :3] * 255 + 0.5)) / 255).max() < 1e-6


def test_lattices():
    rng = np.random.default_rng(5)
    v = rng.random((4, 5, 3))
    sepia = tables.lattice("sepia", 17)
    direct = OPERATORS["sepia"].kernel(np.concatenate([v * 0.5, np.ones((4, 5, 1))], -1), **OPERATORS["sepia"].bind({}))
    assert np.abs(sepia(v * 0.5) - direct[..., :3]).max() < 0.02
    table = tables.level_table("invert")
    exact = Lut.of(lambda x: x * 0.5 + 0.25, 5)
    places = np.array([[0, 0.25, 0.5], [0.75, 1, 0]])  # of the lattice
    level = lambda x: np.floor(x * 255 + 0.5) / 255
    assert np.allclose(tables.absorbed_before(table, exact)(places), (1 - level(places)) * 0.5 + 0.25)
    assert np.allclose(tables.absorbed_after(exact, table)(places), 1 - level(places * 0.5 + 0.25))


def test_users_register(pictures):
    names = ("test_glow", "test_ink")
    try:

        @registry.composite("test_glow", "effect", radius=(1, 0, 9))
        def _(radius):
            return [("box_blur", {"radius": radius}), ("invert", {})]

        @registry.mapper("test_ink", "color", "cmyk8")
        def _(img):
            return img

        @registry.metric("test_worst")
        def worst(a, b):
            return METRICS["metrics"](a, b)

        got = arrays(Pipeline(pictures).test_glow(radius=2).images())
        want = arrays(Pipeline(pictures).box_blur(radius=2).invert().images())
        assert all(np.abs(got[i] - v).max() < 1e-5 for i, v in want.items())
        assert OPERATORS["test_ink"].output == "cmyk8"
        rows = Pipeline(pictures).compare("test_worst", Pipeline(pictures).invert()).collect()
        assert len(rows) == 3 and all(r.mae > 0 for r in rows)
        with pytest.raises(ValueError):
            registry.metric("test_worst")(worst)
    finally:
        for name in names:
            OPERATORS.pop(name, None)
        METRICS.pop("test_worst", None)
