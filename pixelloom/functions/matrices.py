"""Colour matrices and white points (fixed values) and what is composed from them."""

from __future__ import annotations

import numpy as np

# Published colorimetry that results have to agree with.
SRGB_TO_XYZ = np.array([[0.4123907993, 0.3575843394, 0.1804807884], [0.2126390059, 0.7151686788, 0.0721923154], [0.0193308187, 0.1191947798, 0.9505321522]])
XYZ_TO_SRGB = np.array([[3.2409699419, -1.5373831776, -0.4986107603], [-0.9692436363, 1.8759675015, 0.0415550574], [0.0556300797, -0.2039769589, 1.0569715142]])
D65_TO_D60 = np.array([[1.01303, 0.00610531, -0.014971], [0.00769823, 0.998165, -0.00503203], [-0.00284131, 0.00468516, 0.924507]])
D60_TO_D65 = np.array([[0.987224, -0.00611327, 0.0159533], [-0.00759836, 1.00186, 0.00533002], [0.00307257, -0.00509596, 1.08168]])
AP0_TO_XYZ = np.array([[0.9525523959, 0.0, 0.0000936786], [0.3439664498, 0.7281660966, -0.0721325464], [0.0, 0.0, 1.0088251844]])
XYZ_TO_AP0 = np.array([[1.0498110175, 0.0, -0.0000974845], [-0.4959030231, 1.3733130458, 0.0982400361], [0.0, 0.0, 0.9912520182]])
AP1_TO_XYZ = np.array([[0.6624541811, 0.1340042065, 0.1561876870], [0.2722287168, 0.6740817658, 0.0536895174], [-0.0055746495, 0.0040607335, 1.0103391003]])
XYZ_TO_AP1 = np.array([[1.6410233797, -0.3248032942, -0.2364246952], [-0.6636628587, 1.6153315917, 0.0167563477], [0.0117218943, -0.0082844420, 0.9883948585]])
SRGB_TO_XYZ_SHORT = np.array([[0.4124564, 0.3575761, 0.1804375], [0.2126729, 0.7151522, 0.0721750], [0.0193339, 0.1191920, 0.9503041]])
XYZ_TO_SRGB_SHORT = np.array([[3.2404542, -1.5371385, -0.4985314], [-0.9692660, 1.8760108, 0.0415560], [0.0556434, -0.2040259, 1.0572252]])
CAT16 = np.array([[0.401288, 0.650173, -0.051461], [-0.250268, 1.204414, 0.045854], [-0.002079, 0.048952, 0.953127]])
OKLAB_TO_CONES = np.array([[0.4122214708, 0.5363325363, 0.0514459929], [0.2119034982, 0.6806995451, 0.1073969566], [0.0883024619, 0.2817188376, 0.6299787005]])
OKLAB_FROM_CONES = np.array([[0.2104542553, 0.7936177850, -0.0040720468], [1.9779984951, -2.4285922050, 0.4505937099], [0.0259040371, 0.7827717662, -0.8086757660]])
CONES_FROM_OKLAB = np.array([[1.0, 0.3963377774, 0.2158037573], [1.0, -0.1055613458, -0.0638541728], [1.0, -0.0894841775, -1.2914855480]])
SRGB_FROM_CONES = np.array([[4.0767416621, -3.3077115913, 0.2309699292], [-1.2684380046, 2.6097574011, -0.3413193965], [-0.0041960863, -0.7034186147, 1.7076147010]])
#: The usual sepia matrix.
SEPIA = np.array([[0.393, 0.769, 0.189], [0.349, 0.686, 0.168], [0.272, 0.534, 0.131]])
D65_WHITE, D65_XY = (0.95047, 1.0, 1.08883), (0.31270, 0.32900)
#: Camera gamuts to ACEScg.
CAMERA = {
    "arri-logc3": np.array([[0.680206, 0.236137, 0.083658], [0.085415, 1.017471, -0.102886], [0.002057, -0.062563, 1.060506]]),
    "arri-logc4": np.array([[0.750957, 0.144422, 0.104621], [0.000821, 1.007397, -0.008218], [-0.000499, -0.034855, 1.035354]]),
    "red-ipp2": np.array([[0.785043, 0.083844, 0.131118], [0.023172, 1.087892, -0.111055], [-0.073769, -0.314639, 1.388408]]),
    "bmd-gen5": np.array([[0.638008, 0.214704, 0.147288], [0.058137, 0.967925, -0.026062], [-0.002070, -0.062309, 1.064379]]),
    "sony-slog3": np.array([[0.752279, 0.143432, 0.104289], [-0.000156, 1.082357, -0.082201], [-0.000038, -0.067961, 1.067999]]),
}

SRGB_TO_ACESCG = XYZ_TO_AP1 @ D65_TO_D60 @ SRGB_TO_XYZ
ACESCG_TO_SRGB = XYZ_TO_SRGB @ D60_TO_D65 @ AP1_TO_XYZ
AP0_TO_AP1, AP1_TO_AP0 = XYZ_TO_AP1 @ AP0_TO_XYZ, XYZ_TO_AP0 @ AP1_TO_XYZ


def daylight_xy(kelvin: float) -> tuple[float, float]:
    """Chromaticity of CIE daylight."""
    t = min(max(kelvin, 4000.0), 25000.0)
    a = (-4.6070e9, 2.9678e6, 0.09911e3, 0.244063) if t <= 7000 else (-2.0064e9, 1.9018e6, 0.24748e3, 0.237040)
    x = a[0] / t**3 + a[1] / t**2 + a[2] / t + a[3]
    return x, -3.0 * x * x + 2.87 * x - 0.275


def tinted(xy: tuple[float, float], tint: float) -> tuple[float, float]:
    """Chromaticity moved along v of CIE 1960."""
    if abs(tint) < 1e-6:
        return xy
    x, y = xy
    d = -2 * x + 12 * y + 3
    u, v = 4 * x / d, 6 * y / d - tint * 0.02
    d = 2 * u - 8 * v + 4
    return 3 * u / d, 2 * v / d


def adaptation(source: tuple[float, float], target: tuple[float, float]) -> np.ndarray:
    """Von Kries adaptation of linear sRGB in CAT16 cones."""
    xyz = [np.array([x / y, 1.0, (1 - x - y) / y]) for x, y in (source, target)]
    gain = (CAT16 @ xyz[1]) / (CAT16 @ xyz[0])
    return XYZ_TO_SRGB_SHORT @ np.linalg.inv(CAT16) @ np.diag(gain) @ CAT16 @ SRGB_TO_XYZ_SHORT
