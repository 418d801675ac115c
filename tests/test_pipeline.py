"""Chains, sources, sinks and what is kept between runs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.operators import brush, inference, looks
from pixelloom.plans import run, versions
from pixelloom.plans.pipeline import Cache, Pipeline, Step, crop_boxes
from pixelloom.plans.registry import OPERATORS
from pixelloom.sources import codecs, images, metadata
from pixelloom.sources import looks as texts


def image(seed=1, h=11, w=14):
    out = np.random.default_rng(seed).random((h, w, 4), np.float32).astype(float)
    out[..., 3] = 1.0
    return out


@pytest.fixture(scope="module")
def pictures(spark):
    rows = [(i, v.shape[1], v.shape[0], bytearray(run.packed(v))) for i, v in enumerate([image(1), image(2, 7, 9)])]
    return spark.createDataFrame(rows, "image_id long, width long, height long, data binary")


def arrays(df):
    return {r.image_id: run.unpacked(bytes(r.data), r.width, r.height) for r in df.collect()}


def test_pixels_and_images_are_the_same(pictures):
    again = arrays(run.to_images(run.to_pixels(pictures)))
    assert all((again[i] == v).all() for i, v in arrays(pictures).items())


def test_chain(pictures):
    done = Pipeline(pictures).then("invert").gaussian_blur(radius=1.0).median(radius=1).crop(x=1, y=2, w=5, h=4)
    got = arrays(done.images())
    for i, v in arrays(pictures).items():
        v = v.copy()
        v[..., :3] = 1 - v[..., :3]
        v = OPERATORS["median"].kernel(OPERATORS["gaussian_blur"].kernel(v, radius=1.0), radius=1)
        assert np.allclose(got[i], v[2:6, 1:6], atol=1e-6)


def test_kernels_on_pixels_run_by_tiles(pictures):
    pixels = run.to_pixels(pictures)
    kernels = [lambda img: OPERATORS["gaussian_blur"].kernel(img, radius=1.0)]
    small, whole = (arrays(run.to_images(f)) for f in (run.tiles(pixels, kernels, 5, side=4), run.whole_images(pixels, kernels)))
    assert all(np.allclose(small[i], v, atol=1e-6) for i, v in whole.items())


def test_spaces_are_put_in_and_inverse_pairs_cancel(pictures):
    p = Pipeline(pictures).brightness(amount=0.1).asc_cdl(slope_r=1.1).invert()
    assert [s.op.name for s in p.planned()] == ["convert_color_space", "brightness", "asc_cdl", "convert_color_space", "invert"]
    assert [s.op.name for s in Pipeline(pictures, space="acescct").brightness(amount=0.1).planned()] == ["brightness"]


def test_identities_go_and_crops_come_first(pictures):
    p = Pipeline(pictures).exposure(ev=0.0).invert().gamma(gamma=2.0).crop(x=0, y=0, w=3, h=3)
    assert [s.op.name for s in p.planned()] == ["crop", "invert", "gamma"]
    q = Pipeline(pictures).auto_level().crop(x=0, y=0, w=3, h=3)
    assert [s.op.name for s in q.planned()] == ["auto_level", "crop"]


def test_chains_on_whole_images_need_no_shuffle(pictures):
    done = Pipeline(pictures).brightness(amount=0.1).equalize().gaussian_blur(radius=1.0).resize(w=5, h=5, method="bilinear").flip().images()
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow run") == 1


def test_projections_of_a_chain_are_one(pictures):
    done = Pipeline(run.to_pixels(pictures)).invert().gamma(gamma=2.0).evaluate_add(value=0.1).exposure(ev=0.3).pixels()
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert plan.split("MapInPandas")[0].count("Project") == 1


def test_bad_parameters(pictures):
    with pytest.raises(ValueError):
        Pipeline(pictures).brightness(amount=3.0)
    with pytest.raises(TypeError):
        Pipeline(pictures).brightness(amont=0.1)
    with pytest.raises(AttributeError):
        Pipeline(pictures).no_such_operator()


def test_two_inputs(pictures):
    base = Pipeline(pictures)
    same = arrays(base.blend_dual(base, mode=10).images())
    assert all(np.allclose(v[..., :3], 0) for v in same.values())


def test_cache_knows_equal_pipelines(pictures):
    cache = Cache(most=1)
    a, b = Pipeline(pictures).invert(), Pipeline(pictures).invert()
    assert cache.get(a) is cache.get(b)
    assert cache.get(Pipeline(pictures).sepia()) is not cache.get(a)


@pytest.mark.parametrize("name", ["png", "bmp", "qoi", "tiff", "tga", "ppm", "pam", "ico", "gif", "hdr", "fits", "pfm", "exr", "dds"])
def test_files_come_back(name):
    v = image(4)
    data = codecs.encode(v, name)
    got = codecs.decode(data, name)
    assert np.abs(got.frames[0] - v)[..., :3].max() < 0.006
    kind, w, h = images.size_of(data)
    assert (w, h) == (14, 11) and kind == codecs.detect(data)


def test_png_of_all_kinds():
    """Filters, depths, palettes, interlace: files written here by hand."""
    import struct
    import zlib

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    def png(w, h, depth, color, raw, extra=b"", lace=0):
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, color, 0, 0, lace)) + extra + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")

    rows = np.random.default_rng(2).integers(0, 256, (5, 4, 3), dtype=np.uint8)
    lines, before = b"", np.zeros(12, int)
    for y, kind in enumerate((0, 1, 2, 3, 4)):
        cur = rows[y].ravel().astype(int)
        left, corner = np.r_[0, 0, 0, cur[:-3]], np.r_[0, 0, 0, before[:-3]]
        p = left + before - corner
        near = np.where((abs(p - left) <= abs(p - before)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - before) <= abs(p - corner), before, corner))
        guess = [0 * cur, left, before, (left + before) // 2, near][kind]
        lines += bytes([kind]) + ((cur - guess) % 256).astype(np.uint8).tobytes()
        before = cur
    got = codecs.decode_png(png(4, 5, 8, 2, lines)).frames[0]
    assert np.allclose(got[..., :3] * 255, rows)
    table = chunk(b"PLTE", bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])) + chunk(b"tRNS", bytes([0]))
    got = codecs.decode_png(png(4, 1, 2, 3, bytes([0, 0b00011011]), table)).frames[0]
    assert (got[0] == np.array([[0, 0, 0, 0], [1, 0, 0, 1], [0, 1, 0, 1], [0, 0, 1, 1]])).all()
    got = codecs.decode_png(png(2, 1, 16, 0, bytes([0, 255, 255, 128, 0]))).frames[0]
    assert np.allclose(got[0, :, 0], [1.0, 0x8000 / 65535])
    gray = np.arange(64, dtype=np.uint8).reshape(8, 8) * 4
    laced = b"".join(b"\0" + gray[y, x0::dx].tobytes() for y0, x0, dy, dx in ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1)) for y in range(y0, 8, dy))
    assert np.allclose(codecs.decode_png(png(8, 8, 8, 0, laced, lace=1)).frames[0][..., 0] * 255, gray)


def test_block_packed_dds():
    import struct

    head = struct.pack("<4sIIIIIII", b"DDS ", 124, 0, 4, 4, 0, 0, 0) + bytes(44) + struct.pack("<II4sIIIII", 32, 4, b"DXT1", 0, 0, 0, 0, 0) + bytes(20)
    block = struct.pack("<HHI", 0xF800, 0x001F, 0b11100100)  # red, blue, and what lies between, in the first row
    v = codecs.decode_dds(head + block).frames[0]
    assert np.allclose(v[0, :, :3], [[1, 0, 0], [0, 0, 1], [2 / 3, 0, 1 / 3], [1 / 3, 0, 2 / 3]]) and (v[1:, :, 0] == 1).all()
    five = head.replace(b"DXT1", b"DXT5") + bytes([200, 100]) + (0b001000).to_bytes(6, "little") + block
    assert np.allclose(codecs.decode_dds(five).frames[0][0, :3, 3] * 255, [200, 100, 200])


def test_animations():
    frames = [image(i, 6, 5) for i in range(3)]
    for data in (codecs.encode_gif(frames, [10, 20, 30]), codecs.encode_apng(frames, [10, 20, 30])):
        got = codecs.decode(data)
        assert got.delays == [10, 20, 30] and all(np.abs(a - b).max() < 0.006 for a, b in zip(got.frames, frames, strict=True))
    assert len(codecs.decode(codecs.encode_tiff(frames)).frames) == 3


def test_scan_probe_and_write(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.png").write_bytes(codecs.encode_png(image(1)))
    (folder / "b.gif").write_bytes(codecs.encode_gif([image(2, 6, 5), image(3, 6, 5)], [40, 50]))
    (folder / "c.png").write_bytes(b"no image")
    rows = {r.path.rpartition("/")[2]: r for r in images.probe(spark, str(folder)).collect()}
    assert (rows["a.png"].width, rows["a.png"].height, rows["c.png"].format) == (14, 11, None)
    found = images.read(spark, str(folder), frames="all")
    assert sorted((r.path.rpartition("/")[2], r.frame_index, r.delay_ms) for r in found.where("data IS NOT NULL").collect()) == [("a.png", 0, 0), ("b.gif", 0, 40), ("b.gif", 1, 50)]
    assert images.read(spark, str(folder), "*.gif", frames=[1]).count() == 1
    joined = images.encode_frames(found.where("format = 'gif'"), "apng").first()
    assert len(codecs.decode(bytes(joined.content)).frames) == 2
    done = images.write_files(images.encoded(Pipeline(found.where("format = 'png' AND data IS NOT NULL").select("image_id", "width", "height", "data")).median().images(), "bmp"), f"file://{tmp_path}/out")
    path = done.first().path
    assert codecs.decode(open(path, "rb").read()).frames[0].shape == (11, 14, 4)
    spark.dataSource.register(images.ImageFiles)
    (folder / "c.png").unlink()
    assert spark.read.format("pixelloom").option("path", str(folder)).option("frames", "all").load().count() == 3


def test_command_line(spark, tmp_path):
    from pixelloom import cli

    (tmp_path / "a.png").write_bytes(codecs.encode_png(image(1)))
    cli.main(["-i", str(tmp_path / "a.png"), "-ref", "plain", "-filter", "invert", "-with", "plain", "-filter", "blend_dual", "mode=13", "-o", f"file://{tmp_path}/out:qoi"], spark)
    (out,) = (tmp_path / "out").iterdir()
    assert np.allclose(codecs.decode(out.read_bytes()).frames[0][..., :3], 1.0, atol=0.01)
    with pytest.raises(SystemExit):
        cli.parse(["-x"])


def test_metadata(spark):
    fields = {"Make": "Maker", "Orientation": "6", "Artist": "Someone else"}
    assert metadata.read_exif(metadata.write_exif(fields)) == fields
    assert metadata.read_xmp(metadata.write_xmp({"Rating": "5", "Label": "a & b"})) == {"Rating": "5", "Label": "a & b"}
    assert metadata.read_iptc(metadata.write_iptc({"City": "Köln", "Caption": "x"})) == {"City": "Köln", "Caption": "x"}
    df = spark.createDataFrame([({"exif": {"Make": "M", "ColorSpace": "1"}},), ({},)], "m map<string,map<string,string>>")
    rows = df.select(metadata.query("m", "exif.Make").alias("v"), metadata.color_space("m").alias("c"), metadata.dump("m").alias("j")).collect()
    assert [tuple(r)[:2] for r in rows] == [("M", "srgb"), (None, "unknown")] and rows[1].j == "{}"
    with pytest.raises(ValueError):
        metadata.query("m", "exif")


def test_look_files():
    lut = texts.Lut.of(lambda v: v**1.5, 5)
    rgb = np.random.default_rng(1).random((40, 3))
    for back in (texts.parse_cube(texts.format_cube(lut)), texts.parse_csp(texts.format_csp(lut)), texts.parse_3dl(texts.format_3dl(lut))):
        assert np.abs(back(rgb) - lut(rgb)).max() < 1e-3
    hald = texts.format_hald(texts.Lut.of(lambda v: v), 2)
    assert hald.shape == (8, 8, 4) and np.allclose(texts.parse_hald(hald)(rgb), rgb)
    assert np.allclose(texts.parse_cube("LUT_1D_SIZE 3\n0 0 0\n0.5 0.25 1\n1 1 1\n")(np.array([[0.25, 0.5, 0.75]])), [[0.25, 0.25, 1.0]])
    cdl = texts.Cdl((1.1, 1.0, 0.9), (0.0, 0.1, 0.0), (1.0, 1.2, 1.0), 0.8)
    assert texts.parse_cdl(texts.format_cdl(cdl)) == [cdl] and set(cdl.params()) == set(OPERATORS["asc_cdl"].params)
    clf = '<ProcessList id="a"><Matrix><Array dim="3 3">1 0 0 0 1 0 0 0 0.5</Array></Matrix><Range style="Clamp"><minInValue>0</minInValue><maxInValue>1</maxInValue><minOutValue>0</minOutValue><maxOutValue>0.5</maxOutValue></Range></ProcessList>'
    assert np.allclose(texts.parse_clf(clf)(np.array([[1.0, 2.0, 1.0]])), [[0.5, 0.5, 0.25]])
    with pytest.raises(ValueError):
        texts.parse_cube("LUT_3D_SIZE 2\n0 0 0\n")


def test_colour_differences():
    # published pairs of CIEDE2000
    pairs = [((50.0, 2.6772, -79.7751), (50.0, 0.0, -82.7485), 2.0425), ((50.0, 2.49, -0.001), (50.0, -2.49, 0.0009), 7.1792), ((2.0776, 0.0795, -1.1350), (0.9033, -0.0636, -0.5514), 0.9082)]
    for a, b, want in pairs:
        assert looks.delta_e_2000(np.array(a), np.array(b)) == pytest.approx(want, abs=2e-4)


def test_versions(spark, pictures):
    first = versions.cut(pictures, 1, side=4).cache()
    touched = arrays(pictures)
    touched[0][0, 0, 0] = 9.0
    after = spark.createDataFrame([(i, v.shape[1], v.shape[0], bytearray(run.packed(v))) for i, v in touched.items()], pictures.schema)
    more = versions.changed(first, after, 2, side=4)
    assert more.count() == 1
    history = first.union(more)
    now, undone = (arrays(versions.joined(versions.as_of(history, n), side=4)) for n in (2, 1))
    assert now[0][0, 0, 0] == 9.0 and undone[0][0, 0, 0] != 9.0 and (now[1] == undone[1]).all()
    for bits in (8, 16):
        back = arrays(versions.restored(versions.packed(pictures, bits), bits))
        assert all(np.abs(back[i] - v).max() < 1 / (1 << bits) for i, v in arrays(pictures).items())


def test_strokes(spark):
    points = [(1, float(t), 5.0 + 3 * t, 8.0, 1.0, 0.0, 0.0, 0.0, 0.0) for t in range(8)]
    strokes = spark.createDataFrame(points, "stroke_id long, ts double, x double, y double, pressure double, tilt_x double, tilt_y double, rotation double, velocity double")
    layer = spark.range(16 * 32).select(F.lit(0).cast("long").alias("image_id"), F.lit(32).cast("long").alias("width"), F.lit(16).cast("long").alias("height"), F.floor(F.col("id") / 32).alias("y"), (F.col("id") % 32).alias("x"), *(F.lit(v).alias(c) for c, v in zip("rgba", (1.0, 1.0, 1.0, 1.0), strict=True)))
    tip = brush.Brush(diameter=6, spacing=0.3, hardness=1.0, smoothing=0.0)
    found = brush.dabs(strokes, tip).orderBy("dab").collect()
    gaps = np.diff([d.x for d in found])
    # segments of 3 leave 1.2 over, which is passed over again before the next step
    assert found[0].x == 5.0 and np.allclose(gaps, [1.8, 4.2] * 3 + [1.8], atol=1e-9)
    out = {(r.y, r.x): r for r in brush.paint(layer, strokes, tip, (0.0, 0.0, 0.0)).collect()}
    assert len(out) == 512 and out[(8, 15)].r == 0.0 and out[(1, 15)].r == 1.0 and out[(8, 31)].r == 1.0
    assert brush.preset("pencil", diameter=4.0).diameter == 4.0


def test_inference(pictures):
    make = lambda: lambda batch: batch * 2
    for spec in (inference.Input(), inference.Input(tile=4, overlap=1, layout="nchw"), inference.Input(tile=5, padding="zero")):
        got = arrays(inference.infer(pictures, make, spec))
        assert all(np.allclose(got[i][..., :3], v[..., :3] * 2, atol=1e-6) for i, v in arrays(pictures).items())
    mask = arrays(inference.infer(pictures, lambda: lambda batch: batch[..., :1] * 0 + 0.25, inference.Input(), "mask"))
    assert all((v[..., 3] == 0.25).all() for v in mask.values())


def test_stream(spark, tmp_path):
    from pixelloom import streaming

    folder = tmp_path / "in"
    folder.mkdir()
    args = (spark, str(folder), f"{tmp_path}/out", f"{tmp_path}/state", lambda df: Pipeline(df.select("image_id", "width", "height", "data")).median().images())
    for i in range(2):
        (folder / f"{i}.png").write_bytes(codecs.encode_png(image(i)))
        streaming.process(*args).awaitTermination(120)
        assert spark.read.parquet(f"{tmp_path}/out").count() == i + 1


def test_analysis_decides_a_crop(pictures):
    got = arrays(run.to_images(Pipeline(pictures).cropped_by(crop_boxes(pictures, 0.5))))
    for i, v in arrays(pictures).items():
        assert np.allclose(got[i], OPERATORS["smart_crop"].kernel(v, ratio=0.5))


def test_proxies_and_traces(pictures):
    p = Pipeline(pictures).gaussian_blur(radius=4.0).box_blur(radius=3).brightness(amount=0.1)
    half = p.proxy(0.5)
    assert [s.params for s in half.steps] == [{"radius": 2.0}, {"radius": 2}, {"amount": 0.1}]
    assert p.trace() == [("images", "gaussian_blur, box_blur, convert_color_space, brightness, convert_color_space")]
    assert Pipeline(run.to_pixels(pictures)).median().invert().trace() == [("tiles", "median"), ("plan", "invert")]


def _images(spark, arrays_):
    return spark.createDataFrame([(i, v.shape[1], v.shape[0], bytearray(run.packed(v))) for i, v in arrays_.items()], run.IMAGE_SCHEMA)


def test_cache_tells_large_arrays_and_inputs_apart(spark, pictures):
    one, two = np.zeros((50, 50)), np.zeros((50, 50))
    two[25, 25] = 1
    step = lambda v: Step(OPERATORS["brightness"], {"amount": v})
    assert step(one).key() != step(two).key() and step(one).key() == step(one.copy()).key()
    assert step(np.float32(1)).key() != step(np.float64(1)).key()
    base = Pipeline(run.to_pixels(pictures))
    fronts = [run.to_pixels(_images(spark, {0: np.full((4, 4, 4), c)})) for c in (0.1, 0.2)]
    cache = Cache()
    got = [cache.get(base.then("blend_dual", f)) for f in fronts]
    assert got[0] is not got[1] and cache.get(base.then("blend_dual", fronts[0])) is got[0]
    assert cache.get(Pipeline(fronts[0])) is not cache.get(Pipeline(fronts[1]))


def test_versions_of_images_that_change_size(spark):
    """Shrinking to whole tiles, growing, and going back."""
    rng = np.random.default_rng(4)
    large = rng.random((8, 12, 4)).astype(np.float32).astype(float)
    sizes = [large, large[:4, :8], large[:4, :4], large[:6, :9], large]
    history = versions.cut(_images(spark, {7: sizes[0]}), 1, side=4)
    for k, img in enumerate(sizes[1:], 2):
        history = spark.createDataFrame(history.union(versions.changed(history, _images(spark, {7: img}), k, side=4)).collect(), versions.TILES)
    for k, img in enumerate(sizes, 1):
        (got,) = arrays(versions.joined(versions.as_of(history, k), side=4)).values()
        assert got.shape == img.shape and (got == img).all(), k
    untouched = versions.changed(history, _images(spark, {8: large}), 9, side=4)
    assert {r.image_id for r in untouched.collect()} == {8}


def test_strokes_on_their_own_image(spark):
    cols = "image_id long, stroke_id long, ts double, x double, y double, pressure double, tilt_x double, tilt_y double, rotation double, velocity double"
    strokes = spark.createDataFrame([(i, 1, float(t), 2.0 + 2 * t + 3 * i, 4.0 + i, 1.0, 0.0, 0.0, 0.0, 0.0) for i in (0, 2) for t in range(4)], cols)
    layer = run.to_pixels(_images(spark, {i: np.ones((12, 24, 4)) for i in range(3)}))
    tip = brush.Brush(diameter=4, spacing=0.3, hardness=1.0, smoothing=0.0)
    out = arrays(run.to_images(brush.paint(layer, strokes, tip, (0.0, 0.0, 0.0))))
    for i in (0, 2):
        alone = arrays(run.to_images(brush.paint(layer.where(f"image_id = {i}"), strokes.where(f"image_id = {i}").drop("image_id"), tip, (0.0, 0.0, 0.0))))
        assert (out[i] == alone[i]).all() and (out[i] == 0).any()
    assert (out[1] == 1).all()
    assert not (out[0] == out[2]).all()


def test_sizes_from_headers_alone():
    """The header's size, with the pixels cut off, for every format that is written."""
    img = np.random.default_rng(1).random((13, 21, 4))
    img[..., 3] = 1
    for name in codecs.ENCODERS:
        data = codecs.encode(img, name)
        head = data if name == "tiff" else data[: min(len(data), 700 if name in ("jpeg", "exr") else 2900 if name == "fits" else 120)]
        assert images.size_of(head)[1:] == (21, 13) or name == "tga" and images.size_of(data)[1:] == (21, 13), name


def test_cut_files_are_errors():
    img = np.random.default_rng(1).random((64, 64, 4))
    for name in ("jpeg", "png", "gif", "qoi", "bmp", "tiff"):
        data = codecs.encode(img, name)
        for part in (len(data) // 2, len(data) // 8, 12):
            with pytest.raises(ValueError):
                codecs.decode(data[:part], name)


def test_a_broken_file_is_a_row(spark, tmp_path):
    img = np.random.default_rng(1).random((8, 8, 4))
    (tmp_path / "a.png").write_bytes(codecs.encode(img, "png"))
    (tmp_path / "b.png").write_bytes(codecs.encode(img, "png")[:40])
    spark.dataSource.register(images.ImageFiles)
    got = {r.path.rpartition("/")[2]: r for r in spark.read.format("pixelloom").option("path", str(tmp_path)).load().collect()}
    assert got["a.png"].width == 8 and got["b.png"].data is None and got["b.png"].format is None
