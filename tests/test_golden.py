"""Values worked out by hand from the published formulas, for operators of each category."""

import math

import numpy as np
import pytest

from pixelloom.plans import catalog  # noqa: F401  registers all operators
from pixelloom.plans.registry import OPERATORS

#: One pixel, and what each operator makes of its red, green and blue.
PIXEL = (0.2, 0.5, 0.8, 0.6)
POINTS = [
    # adjustment
    ("brightness", {"amount": 0.1}, (0.3, 0.6, 0.9)),
    ("contrast", {"amount": 0.3}, (0.11, 0.5, 0.89)),
    ("exposure", {"ev": 1.0}, (0.4, 1.0, 1.6)),
    ("gamma", {"gamma": 2.0}, (0.4472135955, 0.7071067812, 0.894427191)),
    ("invert", {}, (0.8, 0.5, 0.2)),
    ("levels", {"black": 0.1, "white": 0.9, "gamma": 1.0}, (0.125, 0.5, 0.875)),
    ("posterize", {"levels": 4}, (0.0, 0.6666666667, 1.0)),
    ("solarize", {"threshold": 0.5}, (0.2, 0.5, 0.2)),
    ("dodge", {"amount": 0.5}, (0.4, 1.0, 1.6)),
    ("burn", {"amount": 0.5}, (-0.6, 0.0, 0.6)),
    ("sigmoidal_contrast", {"strength": 4.0, "midpoint": 0.5}, (0.1474174842, 0.5, 0.8525825158)),
    # evaluate
    ("evaluate_add", {"value": 0.25}, (0.45, 0.75, 1.05)),
    ("evaluate_subtract", {"value": 0.25}, (-0.05, 0.25, 0.55)),
    ("evaluate_multiply", {"value": 2.0}, (0.4, 1.0, 1.6)),
    ("evaluate_divide", {"value": 2.0}, (0.1, 0.25, 0.4)),
    ("evaluate_pow", {"exponent": 2.0}, (0.04, 0.25, 0.64)),
    ("evaluate_max", {"threshold": 0.4}, (0.4, 0.5, 0.8)),
    ("evaluate_min", {"threshold": 0.4}, (0.2, 0.4, 0.4)),
    # color
    ("sepia", {"intensity": 1.0}, (0.6143, 0.5472, 0.4262)),
    ("sepia", {"intensity": 0.5}, (0.40715, 0.5236, 0.6131)),
    ("hue_rotate", {"degrees": 120.0}, (0.8, 0.2, 0.5)),
    ("channel_mixer", {"matrix": ((0.0, 1.0, 0.0), (0.0, 0.0, 1.0), (0.5, 0.0, 0.0))}, (0.5, 0.8, 0.1)),
    # grading
    ("tonemap_reinhard", {}, (0.1666666667, 0.3333333333, 0.4444444444)),
    # composite
    ("premultiply", {}, (0.12, 0.3, 0.48)),
    ("unpremultiply", {}, (0.3333333333, 0.8333333333, 1.3333333333)),
]


def apply(name, img, **params):
    op = OPERATORS[name]
    return op.kernel(np.array(img, float), **op.bind(params))


@pytest.mark.parametrize(("name", "params", "want"), POINTS, ids=lambda v: v if isinstance(v, str) else "")
def test_points(name, params, want):
    got = apply(name, [[PIXEL]], **params)[0, 0]
    assert got[:3] == pytest.approx(want, abs=1e-9)
    assert got[3] == PIXEL[3]


def spot(size=7, value=1.0):
    """A bright pixel in the middle of black."""
    out = np.zeros((size, size, 4))
    out[..., 3] = 1
    out[size // 2, size // 2, :3] = value
    return out


def test_box_blur_of_a_spot():
    got = apply("box_blur", spot(), radius=1)[..., 0]
    want = np.zeros((7, 7))
    want[2:5, 2:5] = 1 / 9
    assert np.allclose(got, want)


def test_gaussian_blur_of_a_spot():
    """Weights exp(-d^2 / 2) at sigma 1, made to add up to one along each axis."""
    got = apply("gaussian_blur", spot(21), radius=1.0)[..., 0]
    along = [math.exp(-0.5 * d * d) for d in range(-5, 6)]
    k = [v / sum(along) for v in along]
    assert got[10, 10] == pytest.approx(k[5] ** 2) and got[9, 12] == pytest.approx(k[4] * k[7]) and got.sum() == pytest.approx(1)


def test_median_takes_a_spot_away():
    assert not apply("median", spot(), radius=1)[..., :3].any()


def test_morphology_of_a_spot():
    grown = apply("dilate", spot(), **{k: p for k, p in (("radius", 1),) if k in OPERATORS["dilate"].params})[..., 0]
    assert grown[3, 3] == 1 and grown[2, 3] == 1 and grown[3, 4] == 1 and grown[0, 0] == 0
    assert not apply("erode", spot())[..., :3].any()


def test_sobel_of_a_step():
    """The slope of a step from 0 to 1 weighs 1 + 2 + 1 on both sides of it, and nothing elsewhere."""
    step = np.zeros((5, 6, 4))
    step[:, 3:, :3] = 1
    got = apply("sobel", step)[2, :, 0]
    assert got[1:5] == pytest.approx([0, got[2], got[2], 0]) and got[2] > 0


def test_pixelate_averages_cells():
    name = next(k for k in OPERATORS["pixelate"].params)
    if OPERATORS["pixelate"].kernel is None:
        pytest.skip("a plan only")
    img = np.zeros((4, 4, 4))
    img[..., 0] = np.arange(16).reshape(4, 4) / 16
    assert apply("pixelate", img, **{name: 2})[0, 0, 0] == pytest.approx((0 + 1 + 4 + 5) / 4 / 16)
