"""Properties of kernels, and plain restatements of those that SQL doesn't check."""

import math

import numpy as np
import pytest

from pixelloom.functions import noise
from pixelloom.operators import kernels as k
from pixelloom.plans import catalog  # noqa: F401  registers all operators
from pixelloom.plans.registry import OPERATORS


@pytest.fixture
def img():
    rng = np.random.default_rng(3)
    out = rng.random((12, 15, 4))
    out[..., 3] = 0.75
    return out


def run(name, img, **params):
    op = OPERATORS[name]
    return op.kernel(img.copy(), **op.bind(params))


def test_every_kernel_keeps_its_input_and_gives_finite_channels(img):
    for op in OPERATORS.values():
        if op.kernel is not None:
            before = img.copy()
            out = op.kernel(img, **op.bind(op.example))
            assert (img == before).all(), op.name
            assert out.ndim == 3 and out.shape[2] == 4 and np.isfinite(out).all(), op.name


@pytest.mark.parametrize("shape", [(1, 1), (1, 9), (7, 1), (2, 2)])
def test_small_images(shape):
    small = np.full((*shape, 4), 0.5)
    for op in OPERATORS.values():
        if op.kernel is not None:
            op.kernel(small, **op.bind(op.example))


def test_tiles_give_what_whole_images_give(img):
    """A kernel sees at most its halo: pixels farther away don't matter."""
    big = np.random.default_rng(5).random((40, 44, 4))
    for op in OPERATORS.values():
        if op.kernel is None or op.halo is None:
            continue
        params = op.bind(op.example)
        halo = op.halo(**params)
        full = op.kernel(big, **params)
        y, x, n = 16, 18, 8
        part = op.kernel(big[y - halo : y + n + halo, x - halo : x + n + halo], **params)
        core = part[halo : halo + n, halo : halo + n]
        assert np.allclose(core, full[y : y + n, x : x + n], atol=1e-9), op.name


def test_morphology_is_idempotent(img):
    for name in ("morph_open", "morph_close"):
        once = run(name, img, radius=1)
        assert np.allclose(run(name, once, radius=1), once)


def test_constant_images_stay():
    flat = np.full((9, 9, 4), 0.4)
    for name in ("gaussian_blur", "box_blur", "median", "bilateral", "nlm_denoise", "motion_blur", "bokeh_blur", "lens_blur", "spin_blur", "zoom_blur", "oil_paint", "dilate", "erode", "sharpen"):
        assert np.allclose(run(name, flat), flat), name


def splitmix(seed):
    state = seed
    while True:
        state = (state + 0x9E3779B97F4A7C15) & (2**64 - 1)
        z = state
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & (2**64 - 1)
        yield z ^ (z >> 31)


def test_noise_is_the_sequence(img):
    draws = splitmix(42 ^ noise.SEEDS["uniform"])
    out = run("uniform_noise", img, range=51.0)
    for i in range(20):
        want = img.reshape(-1, 4)[i // 3, i % 3] + ((next(draws) >> 40) / 2**24 * 2 - 1) * 51 / 255
        assert out.reshape(-1, 4)[i // 3, i % 3] == pytest.approx(want, abs=1e-12)
    draws = splitmix(7 ^ noise.SEEDS["salt_pepper"])
    unit = lambda: (next(draws) >> 40) / 2**24
    out = run("salt_pepper_noise", img, density=0.3, seed=7).reshape(-1, 4)
    for i in range(len(out)):
        want = (0.0 if unit() < 0.5 else 1.0) if unit() < 0.3 else None
        if want is not None:
            assert (out[i, :3] == want).all()


@pytest.mark.parametrize("scale", [0.5, 12.0, 300.0])
def test_poisson_noise_is_the_sequence_drawn_in_blocks(img, scale, monkeypatch):
    calls = []
    unit = noise.Sequence.unit
    monkeypatch.setattr(noise.Sequence, "unit", lambda self, n: calls.append(n) or unit(self, n))
    big = np.tile(img, (7, 24, 1))[:80, :300]  # more values than are worked on at once
    out = run("poisson_noise", big, scale=scale)
    assert len(calls) < 20 and max(calls) <= 1 << 16
    states = splitmix(42 ^ noise.SEEDS["poisson"])
    draw = lambda: (next(states) >> 40) / 2**24
    for v, got in zip(big[..., :3].ravel(), out[..., :3].ravel(), strict=True):
        mean = max(v * scale, 0.001)
        if mean > 10:
            far = math.sqrt(-2 * math.log(max(draw(), 1e-10)))
            want = mean + math.sqrt(mean) * far * math.cos(2 * math.pi * draw())
        else:
            want, p = 0, draw()
            while p > math.exp(-mean):
                want, p = want + 1, p * draw()
        assert got == pytest.approx(want / scale, abs=1e-9)


def test_seams_are_least(img):
    carved = k.carve(img[:5, :6], 1)
    rgb = img[:5, :6, :3]
    h, w = 5, 6
    cost = np.zeros((h, w))
    for y in range(h):
        for x in range(w):
            gx = rgb[y, min(x + 1, w - 1)] - rgb[y, max(x - 1, 0)]
            gy = rgb[min(y + 1, h - 1), x] - rgb[max(y - 1, 0), x]
            cost[y, x] = math.sqrt((gx**2).sum()) + math.sqrt((gy**2).sum())
    best = min((sum(cost[y, p[y]] for y in range(h)), p) for p in _paths(h, w))[1]
    for y in range(h):
        assert np.allclose(carved[y], np.delete(img[y, :6], best[y], axis=0))


def _paths(h, w):
    paths = [[x] for x in range(w)]
    for _ in range(h - 1):
        paths = [p + [p[-1] + d] for p in paths for d in (-1, 0, 1) if 0 <= p[-1] + d < w]
    return paths


def test_flood_fill_follows_edges():
    board = np.zeros((5, 5, 4))
    board[:, 2, :3] = 1.0
    out = run("flood_fill", board, seed_x=0.0, seed_y=0.0, tolerance=0.1)
    assert (out[:, :2, 0] == 1.0).all() and (out[:, 3:] == 0).all() and (out[:, 2, 1] == 1.0).all()


def test_palettes(img):
    for name in ("quantize", "kmeans_quantize", "dither_ordered", "dither_floyd_steinberg"):
        colors = {"k": 4} if name.startswith("kmeans") else {"max_colors": 4}
        out = run(name, img, **colors)
        assert len(np.unique(out[..., :3].reshape(-1, 3).round(9), axis=0)) <= 4, name
    many = np.tile(np.linspace(0, 1, 64)[None, :, None], (64, 1, 4))
    dithered = run("dither_floyd_steinberg", many, max_colors=2)
    assert abs(dithered[..., 0].mean() - many[..., 0].mean()) < 0.02


def test_thin_lines_stay_and_thick_ones_thin():
    bar = np.zeros((15, 21, 4))
    bar[5:10, 3:18, :3] = 1.0
    out = run("skeletonize", bar)[..., 0]
    assert 0 < out.sum() < 20 and out[7].sum() > 5


def test_canny_finds_a_step():
    step = np.zeros((20, 20, 4))
    step[:, 10:, :3] = 1.0
    out = run("canny", step, low=0.1, high=0.3)[..., 0]
    assert out[5:15, 8:12].any(axis=1).all() and not out[:, :6].any() and not out[:, 14:].any()


def test_inpainting_fills_from_around():
    flat = np.full((9, 9, 4), 0.6)
    flat[..., 3] = 1
    hole = flat.copy()
    hole[3:6, 3:6] = 0
    assert np.allclose(run("inpaint", hole), flat)


def test_kaleidoscope_mirrors(img):
    out = run("mirror_kaleidoscope", img, segments=3, mode=0)
    assert np.allclose(out[:, :5], img[:, :5]) and np.allclose(out[:, 5:10], img[:, 4::-1]) and np.allclose(out[:, 10:], img[:, :5])


def test_kernels_and_plans_agree(img):
    """Both forms of every operator that has two, on one image."""
    duckdb = pytest.importorskip("duckdb")
    import pandas as pd

    from pixelloom.plans.registry import PIXEL
    from pixelloom.plans.rel import TextRel
    from pixelloom.plans.run import _rows

    rng = np.random.default_rng(11)
    v = rng.random((12, 15, 4))
    v[..., 3] = rng.integers(0, 5, (12, 15)) / 4
    con = duckdb.connect()
    con.register("px", pd.DataFrame(_rows(1, v)))
    checked = 0
    for op in OPERATORS.values():
        if op.kernel is None or op.plan is None or op.inputs > 1:
            continue
        params = op.bind(op.example)
        got = con.execute(op.plan(TextRel("px", PIXEL), **params).sql()).df().sort_values(["y", "x"])
        want = op.kernel(v.copy(), **params)
        assert (got["height"].max(), got["width"].max()) == want.shape[:2], op.name
        assert np.allclose(got[list("rgba")].to_numpy(float), want.reshape(-1, 4), atol=1e-7), op.name
        checked += 1
    assert checked > 170


def _holed(h=20, w=24):
    """A smooth picture and the same with a hole."""
    y, x = np.mgrid[:h, :w]
    full = np.stack([(40 + 4 * x) / 255, (60 + 3 * y) / 255, (30 + 2 * x + 2 * y) / 255, np.ones((h, w))], -1)
    hole = np.zeros((h, w), bool)
    hole[7:12, 8:14] = hole[3, 3] = hole[15:18, 0:3] = True
    cut = full.copy()
    cut[hole] = 0
    return full, cut, hole


@pytest.mark.parametrize("method", [0, 1])
def test_inpainting_goes_on_with_slopes(method):
    full, cut, hole = _holed()
    out = run("inpaint", cut, radius=3, method=method)
    assert (out[~hole] == full[~hole]).all() and (out[hole, 3] == 1).all()
    assert np.abs(out - full)[hole].max() < 16 / 255 and np.abs(out - full)[hole].mean() < 5 / 255
    assert np.allclose(out[hole] * 255, np.rint(out[hole] * 255))


def test_inpainting_of_one_pixel_by_hand():
    """Of one missing pixel all neighbours weigh by nearness alone, times the little that no direction of the front leaves; the slope adds one level at the most."""
    rng = np.random.default_rng(7)
    level = rng.integers(0, 256, (5, 5)).astype(float)
    hole = np.zeros((5, 5), bool)
    hole[2, 2] = True
    got = k.marched(level[..., None], hole, 1, False)[2, 2, 0]
    around = [(1, 2), (2, 1), (2, 3), (3, 2)]
    # the front arrives from all sides at once, so its slope at the pixel is nothing
    mean = np.mean([level[p] for p in around])

    def slope(p, axis):
        step = np.array([axis == 0, axis == 1], int)
        low, high = (tuple(np.array(p) + s * step) for s in (-1, 1))
        if low == (2, 2):
            return level[high] - level[p]
        if high == (2, 2):
            return level[p] - level[low]
        return 2 * (level[high] - level[low])

    j = [sum(slope(p, a) * (p[a] - 2) for p in around) * 1e-6 / 2 for a in (0, 1)]
    want = np.clip(mean + sum(j) / (math.hypot(*j) + 1e-20), 0, 255)
    assert got == np.floor(want + 0.5) or abs(got - want) <= 0.5 + 1e-6
    assert (k.marched(level[..., None], hole, 1, True)[~hole, 0] == level[~hole]).all()


def test_front_keeps_distances():
    """Times of arrival grow by one straight, and as the solution of two neighbours across."""
    t, known = np.zeros((3, 3)), np.zeros((3, 3), bool)
    known[0, 1] = True
    assert k._arrival(t, known, 1, 1) == 1
    known[1, 0] = True
    assert k._arrival(t, known, 1, 1) == pytest.approx(math.sqrt(2) / 2)
    t[1, 0] = 2
    assert k._arrival(t, known, 1, 1) == 1


def test_single_precision_is_close(img):
    for op in OPERATORS.values():
        if op.single:
            exact, fast = (op.kernel(v, **op.bind(op.example)) for v in (img, img.astype(np.float32)))
            assert fast.dtype == np.float32 and np.abs(exact - fast).max() < 5e-6, op.name
