"""Numpy kernels on one image: height x width x 3 arrays in red, green, blue order, values 0 to 255.

They run inside Arrow maps (`prismspark.operators.images`); none of them sees Spark. Images too small for a measure
get the value stated at each kernel, so that every image yields the same fields.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

TINY = 1e-12
# Luminance weights.
LUMA = np.array([0.299, 0.587, 0.114])
CHANNELS = ("r", "g", "b")


def luminance(rgb: np.ndarray) -> np.ndarray:
    """Grey image of whole numbers, as floats."""
    return np.rint(rgb.astype(np.float64) @ LUMA)


def gaussian(plane: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian of round(8 sigma + 1) taps (made odd), borders mirrored without repeating the edge."""
    radius = (int(round(8 * sigma + 1)) | 1) // 2
    taps = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    taps /= taps.sum()
    for axis in (0, 1):
        width = [(0, 0), (0, 0)]
        width[axis] = (radius, radius)
        padded = np.pad(plane, width, mode="reflect" if plane.shape[axis] > 1 else "edge")
        plane = np.lib.stride_tricks.sliding_window_view(padded, taps.size, axis=axis) @ taps
    return plane


@lru_cache(maxsize=8)
def area_weights(source: int, target: int) -> np.ndarray:
    """target x source matrix: the share of every source cell in every target cell."""
    edges = np.linspace(0, source, target + 1)
    cells = np.arange(source)
    share = np.minimum(edges[1:, None], cells + 1) - np.maximum(edges[:-1, None], cells)
    share = np.clip(share, 0, None)
    return share / share.sum(axis=1, keepdims=True)


@lru_cache(maxsize=8)
def cubic_weights(source: int, target: int, a: float = -0.75) -> np.ndarray:
    """target x source matrix of cubic convolution at cell centres, edges repeated."""
    out = np.zeros((target, source))
    centre = (np.arange(target) + 0.5) * source / target - 0.5
    base = np.floor(centre).astype(int)
    for tap in range(-1, 3):
        d = np.abs(centre - (base + tap))
        near = (a + 2) * d**3 - (a + 3) * d**2 + 1
        far = a * d**3 - 5 * a * d**2 + 8 * a * d - 4 * a
        np.add.at(out, (np.arange(target), np.clip(base + tap, 0, source - 1)), np.where(d <= 1, near, np.where(d < 2, far, 0.0)))
    return out


def resize(plane: np.ndarray, height: int, width: int, growth=area_weights) -> np.ndarray:
    """Area average; an axis that grows takes the weights of growth."""
    rows = (area_weights if plane.shape[0] >= height else growth)(plane.shape[0], height)
    columns = (area_weights if plane.shape[1] >= width else growth)(plane.shape[1], width)
    found = rows @ plane @ columns.T
    return np.clip(found, 0, 255, out=found)


@lru_cache(maxsize=8)
def line_runs(source: int, target: int, cell: int) -> tuple[np.ndarray, np.ndarray]:
    """Of target lines made of source ones by area those that differ, and the number of lines that each stands for: every run
    of more than four lines with equal weights is cut to four. Runs end at multiples of cell.

    The second line of a run stands for all that have one equal line before and two behind them, so what depends on a pixel,
    on the line before it and on the two behind it can be counted on the few lines kept. Enlarged images are mostly runs."""
    weights = area_weights(source, target)
    new = np.ones(target, bool)
    new[1:] = (weights[1:] != weights[:-1]).any(axis=1)
    new[::cell] = True
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, target))
    within = np.arange(target) - np.repeat(starts, sizes)
    behind = np.repeat(sizes, sizes) - within - 1
    kept = np.flatnonzero((within < 2) | (behind < 2))
    return kept, np.where((within == 1) & (behind >= 2), behind - 1, 1)[kept]


def shrunk(plane: np.ndarray, side: int, cell: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """The lines of line_runs() of plane at side x side, in whole numbers, and per axis their places and counts."""
    (rows, n_rows), (columns, n_columns) = (line_runs(n, side, cell) for n in plane.shape)
    found = area_weights(plane.shape[0], side)[rows] @ plane @ area_weights(plane.shape[1], side)[columns].T
    return np.rint(np.clip(found, 0, 255)), [rows, columns], [n_rows, n_columns]


def tiles(plane: np.ndarray, size: int) -> np.ndarray:
    """(rows, columns, size, size) of whole tiles; partial ones are dropped."""
    h, w = plane.shape[0] // size, plane.shape[1] // size
    return plane[: h * size, : w * size].reshape(h, size, w, size).swapaxes(1, 2)


def quantile(values: np.ndarray, share: float) -> float:
    """Percentile between the two nearest, by one selection: numpy's own selects several places at ten times the time."""
    place = (values.size - 1) * share / 100
    low = math.floor(place)
    parted = np.partition(values, low, axis=None)
    above = parted[low + 1 :].min() if low + 1 < values.size else parted[low]
    return float(parted[low] + (above - parted[low]) * (place - low))


def entropy(p: np.ndarray) -> float:
    p = p[p > 0]
    return float(-(p * np.log2(p)).sum()) if p.size else 0.0


def histogram(rgb: np.ndarray) -> dict:
    """Mean, deviation, entropy, empty bins and shares of 0 and 255 of each channel; range of the grey image."""
    out = {}
    for i, name in enumerate(CHANNELS):
        values = rgb[:, :, i].ravel()
        share = np.bincount(values, minlength=256) / values.size
        out |= {
            f"{name}_mean": float(values.mean()),
            f"{name}_std": float(values.std()),
            f"{name}_entropy": entropy(share),
            f"{name}_zero_bins": float((share == 0).sum()),
            f"{name}_clip_low": float(share[0]),
            f"{name}_clip_high": float(share[255]),
        }
    gray = luminance(rgb)
    return out | {"dynamic_range": float(gray.max() - gray.min())}


def residual_stats(plane: np.ndarray, sigma: float) -> dict:
    res = plane - gaussian(plane, sigma)
    mid = np.median(res)
    return {"residual_mean": float(res.mean()), "residual_std": float(res.std()), "residual_mad": float(np.median(np.abs(res - mid)))}


def block_cv(stack: np.ndarray) -> tuple[float, float]:
    """Mean and coefficient of variation of the deviation of 64 x 64 tiles of a residual; without a tile the whole deviation and 0."""
    planes = stack[:, :, None] if stack.ndim == 2 else stack
    parts = np.stack([tiles(planes[:, :, c], 64) for c in range(planes.shape[2])], axis=-1)
    if parts.size == 0:
        return float(stack.std()), 0.0
    deviation = parts.std(axis=(2, 3, 4))
    return float(deviation.mean()), float(deviation.std() / (deviation.mean() + TINY))


def noise_map(rgb: np.ndarray) -> dict:
    gray = luminance(rgb) / 255
    mean, cv = block_cv(gray - gaussian(gray, 1.2))
    return residual_stats(gray, 1.2) | {"block_sigma_mean": mean, "block_sigma_cv": cv}


def sensor_screen(rgb: np.ndarray) -> dict:
    res = np.stack([rgb[:, :, c] / 255 - gaussian(rgb[:, :, c] / 255, 1.0) for c in range(3)], axis=2)
    mean, cv = block_cv(res)
    return {"block_sigma_mean": mean, "block_sigma_cv": cv, "global_sigma": float(res.std())}


def chi2_survival(x: float) -> float:
    """Upper tail of the chi-square distribution with one degree of freedom."""
    return math.erfc(math.sqrt(max(0.0, x) / 2))


def lsb_screen(rgb: np.ndarray) -> dict:
    """Balance of the lowest bits of each channel."""
    out = {}
    for i, name in enumerate(CHANNELS):
        n = rgb[:, :, i].size
        ones = int((rgb[:, :, i] & 1).sum())
        chi2 = (2 * ones - n) ** 2 / n
        out |= {f"{name}_p1": ones / n, f"{name}_entropy": entropy(np.array([ones, n - ones]) / n), f"{name}_chi2": chi2, f"{name}_p_value": chi2_survival(chi2)}
    return out


@lru_cache(maxsize=8)
def dct_matrix(n: int) -> np.ndarray:
    """Orthonormal DCT-II."""
    k = np.arange(n)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n)) * math.sqrt(2 / n)
    basis[0] /= math.sqrt(2)
    return basis


def frequency_ratio(gray: np.ndarray) -> float:
    """Mean size of the cosine coefficients in the highest half over that in the lowest quarter, at 256 x 256."""
    side = dct_matrix(256)
    found = np.abs(side @ resize(gray.astype(float), 256, 256) @ side.T)
    return float(found[128:, 128:].mean() / (found[:64, :64].mean() + TINY))


def bits_to_hex(bits: np.ndarray) -> str:
    return np.packbits(bits.ravel()).tobytes().hex()


def rounded(values, digits: int | None):
    """values, rounded where given, so that the order of adding cannot turn a decision."""
    return values if digits is None else np.round(values, digits)


def dct_hash(gray: np.ndarray, digits: int | None = None) -> str:
    """Which of the 8 x 8 lowest frequencies at 32 x 32 reach the median of rows 1 to 7, first bit highest."""
    basis = dct_matrix(32)
    low = rounded((basis @ np.rint(rounded(resize(gray, 32, 32), digits)) @ basis.T)[:8, :8], digits)
    return bits_to_hex(low >= np.median(low[1:]))


def perceptual_hashes(rgb: np.ndarray) -> dict[str, str]:
    """Average, difference and DCT hash of 64 bits, first bit highest."""
    gray = luminance(rgb)
    small, wide = np.rint(resize(gray, 8, 8)), np.rint(resize(gray, 8, 9))
    return {
        "average_hash": bits_to_hex(small >= small.mean()),
        "difference_hash": bits_to_hex(wide[:, 1:] >= wide[:, :-1]),
        "dct_hash": dct_hash(gray),
    }


def dct_periodicity(gray: np.ndarray, digits: int | None = None) -> dict:
    """Gaps in the histogram of the DCT coefficient (1, 2) of 8 x 8 blocks; 0 below 10 blocks or 5 bins (then dct_bins, which
    only a rounded result has, is below 5)."""
    basis = dct_matrix(8)
    k = np.rint(rounded(np.einsum("a,hwab,b->hw", basis[1], tiles(gray - 128.0, 8), basis[2]), digits)).ravel()
    none = {"dct_score": 0.0, "dct_zero_fraction": 0.0, "dct_blocks": float(k.size)} | ({} if digits is None else {"dct_bins": 0})
    if k.size < 10:
        return none
    low, high = (int(v) for v in rounded(np.percentile(k, [2, 98]), digits))
    bins = high - low + 1
    if bins < 5:
        return none
    # The last bin is closed: it also takes the value just above the range.
    counts = np.histogram(k, bins=np.arange(low, high + 2))[0]
    zero = float((counts == 0).mean())
    alternation = float(np.abs(np.diff(counts)).mean() / (counts.mean() + 1e-9))
    return none | {"dct_score": min(1.0, 0.5 * zero + 0.05 * alternation), "dct_zero_fraction": zero} | ({} if digits is None else {"dct_bins": bins})


def polar_radius(h: int, w: int) -> np.ndarray:
    return np.hypot(np.arange(h)[:, None] - h // 2, np.arange(w)[None, :] - w // 2)


def log_spectrum(gray: np.ndarray) -> np.ndarray:
    return np.log1p(np.abs(np.fft.fftshift(np.fft.fft2(gray - gray.mean()))))


def radial_profile(gray: np.ndarray, rings: int = 64) -> dict:
    """Rings of the log spectrum: low and high means, their ratio, local peaks above 1.5 deviations, spread of quadrants."""
    mag = log_spectrum(gray)
    h, w = mag.shape
    radius, reach = polar_radius(h, w), max(1, min(h // 2, w // 2))
    ring = np.minimum((radius * rings / reach).astype(int), rings)
    total = np.bincount(ring.ravel(), mag.ravel(), minlength=rings + 1)[:rings]
    count = np.bincount(ring.ravel(), minlength=rings + 1)[:rings]
    profile = np.where(count > 0, total / np.maximum(count, 1), 0.0)
    z = (profile - profile.mean()) / (profile.std() + TINY)
    peaks = int(((z[1:-1] > 1.5) & (z[1:-1] > z[:-2]) & (z[1:-1] > z[2:])).sum())
    far = radius > 0.08 * reach
    top, left = np.arange(h)[:, None] < h // 2, np.arange(w)[None, :] < w // 2
    means = [mag[far & a & b].mean() if (far & a & b).any() else 0.0 for a in (top, ~top) for b in (left, ~left)]
    low, high = float(profile[1 : rings // 4].mean()), float(profile[rings * 3 // 4 :].mean())
    return {"profile_low": low, "profile_high": high, "high_low_ratio": high / (low + TINY), "peak_count": float(peaks), "quadrant_cv": float(np.std(means) / (np.mean(means) + TINY))}


def ring_means(gray: np.ndarray) -> dict:
    mag = log_spectrum(gray)
    radius = polar_radius(*mag.shape) / max(1.0, min(mag.shape[0] // 2, mag.shape[1] // 2))
    # Rings as shares of the reach.
    bounds = ((0.05, 0.25), (0.25, 0.50), (0.50, 0.75), (0.75, 1.0))
    means = [float(mag[inside].mean()) if (inside := (radius >= a) & (radius < b)).any() else 0.0 for a, b in bounds]
    return {f"fft_band_{i}_mean": m for i, m in enumerate(means, 1)} | {"fft_hf_lf_ratio": means[3] / (means[0] + TINY)}


def autocorrelation(signal: np.ndarray) -> np.ndarray:
    """Autocorrelation over the energy at lags 0, 1, ..."""
    z = signal - signal.mean()
    n = z.size
    f = np.fft.rfft(z, 2 * n)
    return np.fft.irfft(f * np.conj(f), 2 * n)[:n] / ((z * z).sum() + TINY)


def resampling_screen(gray: np.ndarray) -> dict:
    """Persistence of the autocorrelation (lag 2 over lag 1) of mean second derivatives along both axes; null where undefined."""

    def persistence(axis: int):
        if gray.shape[axis] < 4:
            return None
        padded = np.pad(gray, 1, mode="reflect" if min(gray.shape) > 1 else "edge")
        second = np.abs(np.diff(padded, 2, axis=axis))
        other = 1 - axis
        smooth = sum(weight * np.take(second, np.arange(i, i + gray.shape[other]), axis=other) for i, weight in enumerate((1, 2, 1)))
        ac = autocorrelation(np.abs(smooth).mean(axis=other))
        return float(ac[2] / ac[1]) if abs(ac[1]) >= TINY else None

    x, y = persistence(1), persistence(0)
    known = [v for v in (x, y) if v is not None]
    return {"persistence_x": x, "persistence_y": y, "persistence": max(known) if known else None}


def haar_energies(gray: np.ndarray, levels: int = 3) -> dict:
    """Mean squared details per level; levels below 4 pixels are 0."""
    keep, out = gray / 255.0, {}
    for level in range(1, levels + 1):
        names = [f"wavelet_l{level}_{part}" for part in ("lh_energy", "hl_energy", "hh_energy", "hf_total")]
        h, w = keep.shape[0] // 2 * 2, keep.shape[1] // 2 * 2
        if min(h, w) < 4:
            out |= dict.fromkeys(names, 0.0)
            continue
        across = keep[:h, 0:w:2] + keep[:h, 1:w:2], keep[:h, 0:w:2] - keep[:h, 1:w:2]
        (keep, hl), (lh, hh) = [((s[0::2] + s[1::2]) / 2, (s[0::2] - s[1::2]) / 2) for s in across]
        energies = [float((d * d).mean()) for d in (lh, hl, hh)]
        out |= dict(zip(names, energies + [sum(energies)]))
    return out


def channel_statistics(rgb: np.ndarray) -> dict:
    """Correlations of channel pairs (0 when one is flat), mean, deviation and skew of each."""
    flat = rgb.reshape(-1, 3).astype(np.float64)
    mean, std = flat.mean(axis=0), flat.std(axis=0)
    out = {}
    for a, b in ((0, 1), (0, 2), (1, 2)):
        joint = ((flat[:, a] - mean[a]) * (flat[:, b] - mean[b])).mean()
        out[f"rgb_corr_{CHANNELS[a]}{CHANNELS[b]}"] = float(joint / (std[a] * std[b])) if std[a] * std[b] > TINY else 0.0
    for i, name in enumerate(CHANNELS):
        skew = ((flat[:, i] - mean[i]) / (std[i] + TINY)) ** 3
        out |= {f"{name}_mean": float(mean[i]), f"{name}_std": float(std[i]), f"{name}_skew": float(skew.mean())}
    return out


def cooccurrence(levels_image: np.ndarray, levels: int = 16, counts: list[np.ndarray] | None = None) -> dict:
    """Five properties of the symmetric co-occurrence of grey levels, averaged over distances 1, 2 and 0, 45, 90 degrees.
    counts are those of shrunk()."""
    i, j = np.meshgrid(np.arange(levels), np.arange(levels), indexing="ij")
    pairs = []
    h, w = levels_image.shape
    each = None if counts is None else np.outer(*counts).astype(float)
    for d in (1, 2):
        for degrees in (0, 45, 90):
            dy, dx = round(math.sin(math.radians(degrees)) * d), round(math.cos(math.radians(degrees)) * d)
            first, second = levels_image[: h - dy, : w - dx], levels_image[dy:, dx:]
            weights = None if each is None else each[: h - dy, : w - dx].ravel()
            pairs.append(np.bincount((first * levels + second).ravel(), weights, minlength=levels * levels).reshape(levels, levels))
    p = np.stack(pairs).astype(float)
    p = (p + p.swapaxes(1, 2)) / (2 * p.sum(axis=(1, 2), keepdims=True))
    total = lambda of: (p * of).sum(axis=(1, 2))
    mean = total(i)[:, None, None]
    variance, joint = total((i - mean) ** 2), total((i - mean) * (j - mean))
    correlation = np.where(variance > 1e-15, joint / np.maximum(variance, 1e-15), 1.0)
    found = [total((i - j) ** 2), total(np.abs(i - j)), total(1 / (1 + (i - j) ** 2)), np.sqrt(total(p)), correlation]
    names = ("contrast", "dissimilarity", "homogeneity", "energy", "correlation")
    return {f"glcm_{name}": float(v) for name, v in zip(names, np.mean(found, axis=1))}


def uniform_patterns(gray: np.ndarray, counts: list[np.ndarray] | None = None) -> dict:
    """Share of the uniform local binary patterns 0 to 8 (ones of the circle) and of all others (9); outside counts as 0.
    counts are those of shrunk()."""
    h, w = gray.shape
    padded = np.pad(gray, 1)

    def shifted(dy: float, dx: float) -> np.ndarray:
        y0, x0 = math.floor(dy), math.floor(dx)
        fy, fx = dy - y0, dx - x0
        total = np.zeros((h, w))
        for oy, wy in ((0, 1 - fy), (1, fy)):
            for ox, wx in ((0, 1 - fx), (1, fx)):
                if wy * wx > 0:
                    total += wy * wx * padded[1 + y0 + oy : 1 + y0 + oy + h, 1 + x0 + ox : 1 + x0 + ox + w]
        return total

    circle = [(round(-math.sin(2 * math.pi * k / 8), 5), round(math.cos(2 * math.pi * k / 8), 5)) for k in range(8)]
    bits = np.stack([shifted(dy, dx) >= gray for dy, dx in circle])
    changes = (bits != np.roll(bits, 1, axis=0)).sum(axis=0)
    code = np.where(changes <= 2, bits.sum(axis=0), 9)
    weights = None if counts is None else np.outer(*counts).ravel().astype(float)
    share = np.bincount(code.ravel(), weights, minlength=10) / (code.size if weights is None else weights.sum())
    return {f"lbp_uniform_{k}": float(share[k]) for k in range(10)}


def gradient_blocks(gray: np.ndarray, cell: int = 16, bins: int = 9, kept: tuple | None = None) -> dict:
    """Summary of oriented gradient histograms in blocks of 2 x 2 cells, normalised, clipped at 0.2 and normalised again.
    kept are the places and counts of shrunk()."""
    dy, dx = np.zeros_like(gray), np.zeros_like(gray)
    dy[1:-1], dx[:, 1:-1] = gray[2:] - gray[:-2], gray[:, 2:] - gray[:, :-2]
    size = np.hypot(dy, dx)
    which = np.minimum((np.degrees(np.arctan2(dy, dx)) % 180 * bins / 180).astype(int), bins - 1)
    places, counts = kept or ([np.arange(n) for n in gray.shape], [np.ones(n) for n in gray.shape])
    # Lines after the last whole cell are left out.
    rows, columns = ((place[-1] + 1) // cell for place in places)
    inside = np.ix_(places[0] < rows * cell, places[1] < columns * cell)
    at = ((places[0] // cell)[:, None] * columns + places[1] // cell) * bins + which
    share = size * np.outer(*counts) / cell**2
    cells = np.bincount(at[inside].ravel(), share[inside].ravel(), minlength=rows * columns * bins).reshape(rows, columns, bins)
    h, w = cells.shape[0] - 1, cells.shape[1] - 1
    blocks = np.concatenate([cells[a : a + h, b : b + w] for a in (0, 1) for b in (0, 1)], axis=-1).reshape(h * w, -1)
    for clip in (0.2, None):
        blocks = blocks / np.sqrt((blocks**2).sum(axis=1, keepdims=True) + 1e-10)
        blocks = np.minimum(blocks, clip) if clip else blocks
    v = blocks.ravel()
    return {"hog_mean": float(v.mean()), "hog_std": float(v.std()), "hog_p90": quantile(v, 90), "hog_sparsity": float((v < 1e-3).mean())}


def is_grey(rgb: np.ndarray) -> bool:
    return bool((rgb[:, :, 0] == rgb[:, :, 1]).all() and (rgb[:, :, 0] == rgb[:, :, 2]).all())


def upsampling_tensor(rgb: np.ndarray, side: int = 256, crop: int = 224) -> np.ndarray:
    """Per channel the log spectrum of the centre crop, its 5th to 95th percentile stretched to -1 .. 1 (flat: zeros).
    Equal channels are computed once."""
    start = (side - crop) // 2
    planes = []
    for c in range(1 if is_grey(rgb) else 3):
        plane = resize(rgb[:, :, c].astype(np.float64), side, side, cubic_weights)[start : start + crop, start : start + crop]
        plane = np.rint(plane, out=plane) / 255
        # Of a real image one half of the spectrum is the other mirrored at the origin.
        half = np.log(np.abs(np.fft.rfft2(plane)) + 1e-3)
        back = crop - np.arange(half.shape[1], crop)
        log = np.concatenate((half, half[-np.arange(crop) % crop][:, back]), axis=1)
        low, high = quantile(log, 5), quantile(log, 95)
        if high - low > TINY:
            log -= low
            log /= high - low
            log *= 2
            log -= 1
            planes.append(np.clip(log, -1, 1, out=log))
        else:
            planes.append(np.zeros_like(log))
    return np.stack(planes) if len(planes) == 3 else np.broadcast_to(planes[0], (3, crop, crop))


@lru_cache(maxsize=2)
def band_squares(side: int) -> dict[str, slice]:
    """Lines of the centred squares of a shifted spectrum, each inside the next."""
    # Bounds of the squares at side 224.
    squares = {"low": (57, 177), "mid": (21, 203), "full": (0, 224)}
    return {name: slice(round(a * side / 224), round(b * side / 224)) for name, (a, b) in squares.items()}


def band_masks(side: int) -> dict[str, np.ndarray]:
    """Bands of the squares that partition the shifted spectrum."""
    inside = {}
    for name, lines in band_squares(side).items():
        inside[name] = np.zeros((side, side), bool)
        inside[name][lines, lines] = True
    return {"full": inside["full"], "low": inside["low"], "mid": inside["mid"] & ~inside["low"], "high": ~inside["mid"]}


def replication_peak(profile: np.ndarray, digits: int | None = None) -> tuple[float, int]:
    """Highest autocorrelation and its lag, from max(2, n / 64) to below n / 2; (0, 0) when short or flat."""
    n = profile.size
    if n < 8 or n * profile.var() <= TINY:
        return 0.0, 0
    ac = rounded(autocorrelation(profile), digits)
    first = max(2, n // 64)
    lag = first + int(np.argmax(ac[first : max(first + 1, n // 2)]))
    return float(ac[lag]), lag


def upsampling_descriptors(rgb: np.ndarray) -> dict:
    """25 descriptors of the regular traces that upsampling leaves in a spectrum; they raise no flag."""
    tensor = upsampling_tensor(rgb)
    # Equal channels have equal spectra: one stands for all.
    centred, out, size = np.fft.fftshift(tensor[:1] if tensor.strides[0] == 0 else tensor, axes=(1, 2)), {}, {}
    absolute = np.abs(centred)
    n = centred[0].size
    # Sums, squares and absolutes of each channel in the nested squares; a band is a square without that inside it.
    inner = {mode: np.array([[part.sum(), (part * part).sum(), a[lines, lines].sum()] for part, a in ((c[lines, lines], a) for c, a in zip(centred, absolute))]) for mode, lines in band_squares(centred.shape[1]).items()}
    bands = {"full": inner["full"], "low": inner["low"], "mid": inner["mid"] - inner["low"], "high": inner["full"] - inner["mid"]}
    deviation = lambda total, squares, n: math.sqrt(max(0.0, squares / n - (total / n) ** 2))
    for mode, sums in bands.items():
        # What lies outside of a band counts as 0.
        total, squares, size[mode] = (float(v) / (n * len(sums)) for v in sums.sum(axis=0))
        out |= {f"autogan_{mode}_mean_abs": size[mode], f"autogan_{mode}_std": deviation(total, squares, 1)}
    total = max(size["low"] + size["mid"] + size["high"], TINY)
    out |= {f"autogan_{mode}_energy_fraction": size[mode] / total for mode in ("low", "mid", "high")}
    mean = absolute.mean(axis=0)
    for axis, name in ((0, "x"), (1, "y")):
        peak, lag = replication_peak(mean.mean(axis=axis))
        out |= {f"autogan_replication_autocorr_peak_{name}": peak, f"autogan_replication_lag_{name}": float(lag)}
    half = mean.shape[0] // 2
    quarters = np.stack([mean[a, b].ravel() for a in (slice(half), slice(-half, None)) for b in (slice(half), slice(-half, None))])
    apart = quarters - quarters.mean(axis=1, keepdims=True)
    joint = apart @ apart.T / quarters.shape[1]
    std = np.sqrt(np.diag(joint))
    pairs = [abs(joint[p, q] / (std[p] * std[q])) for p in range(4) for q in range(p + 1, 4) if min(std[p], std[q]) > 1e-8]
    out["autogan_quadrant_replication_score"] = float(np.mean(np.minimum(pairs, 1.0))) if pairs else 0.0
    # No absolute is over 1, so where more than a twentieth are 1, the 95th percentile is.
    each = [{"mean": float(sums[0] / n), "std": deviation(sums[0], sums[1], n), "abs_p95": 1.0 if np.count_nonzero(a == 1.0) > n // 20 + 1 else quantile(a, 95)} for sums, a in zip(inner["full"], absolute)]
    for i, name in enumerate(CHANNELS):
        out |= {f"autogan_{name}_{what}": v for what, v in each[i % len(each)].items()}
    return out


def feature_bank(rgb: np.ndarray) -> dict[str, float]:
    """All 73 features: 48 of texture, spectrum and colour, 25 of upsampling."""
    gray = luminance(rgb)
    few, _, counts = shrunk(gray, 256, 256)
    by_cell, *kept = shrunk(gray, 256, 16)
    levels = np.clip(few / 16, 0, 15).astype(int)
    return haar_energies(gray) | channel_statistics(rgb) | cooccurrence(levels, counts=counts) | uniform_patterns(few, counts) | gradient_blocks(by_cell, kept=kept) | ring_means(gray) | upsampling_descriptors(rgb)


FEATURES = sorted(feature_bank(np.zeros((8, 8, 3), np.uint8)))


def slide(mask: np.ndarray, size: int, grow: bool) -> np.ndarray:
    """Maximum or minimum over a square; outside does not count."""
    r = size // 2
    padded = np.pad(mask, r, constant_values=not grow)
    view = np.lib.stride_tricks.sliding_window_view(padded, (size, size))
    return view.any(axis=(2, 3)) if grow else view.all(axis=(2, 3))


def regions(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """Labels from 1 of the 8-connected regions: row runs joined to the runs they touch in the row above."""
    parent: list[int] = []

    def root(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    runs, above = [], []
    for y in range(mask.shape[0]):
        edge = np.flatnonzero(np.diff(np.concatenate(([0], mask[y].astype(np.int8), [0]))))
        here = []
        for a, b in zip(edge[0::2], edge[1::2]):
            me = len(parent)
            parent.append(me)
            for c, d, other in above:
                if c <= b and a <= d:
                    parent[root(me)] = root(other)
            here.append((a, b, me))
            runs.append((y, a, b, me))
        above = here
    number: dict[int, int] = {}
    labels = np.zeros(mask.shape, int)
    for y, a, b, me in runs:
        labels[y, a:b] = number.setdefault(root(me), len(number) + 1)
    return labels, len(number)


def reference_difference(questioned: np.ndarray, reference: np.ndarray, floor: float = 12.0, sigmas: float = 8.0, least_area: int = 50) -> dict:
    """Changed regions against a reference: robust threshold, opening 3 x 3, closing 7 x 7, regions by area."""
    if questioned.shape != reference.shape:
        return {"status": "not_comparable", "threshold": None, "changed_fraction": None, "component_count": None, "components": []}
    diff = np.abs(questioned.astype(np.float64) - reference).mean(axis=2)
    mid = np.median(diff)
    threshold = max(floor, float(mid + sigmas * 1.4826 * np.median(np.abs(diff - mid))))
    mask = diff >= threshold
    for size, grow in ((3, False), (3, True), (7, True), (7, False)):
        mask = slide(mask, size, grow)
    labels, count = regions(mask)
    found = []
    for k in range(1, count + 1):
        ys, xs = np.nonzero(labels == k)
        if ys.size >= least_area:
            found.append({"x": int(xs.min()), "y": int(ys.min()), "w": int(np.ptp(xs) + 1), "h": int(np.ptp(ys) + 1), "area": int(ys.size), "mean_difference": float(diff[ys, xs].mean())})
    found.sort(key=lambda c: -c["area"])
    return {"status": "success", "threshold": threshold, "changed_fraction": float(mask.mean()), "component_count": len(found), "components": found[:20]}


def laplacian_variance(gray: np.ndarray) -> float:
    p = np.pad(gray, 1, mode="reflect" if min(gray.shape) > 1 else "edge")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * gray).var())


def face_measures(rgb: np.ndarray, box: tuple[int, int, int, int]) -> dict:
    """A given face box against its surroundings: sharpness, left-right asymmetry, ratios of residual and sharpness (null without context)."""
    x, y, w, h = box
    gray = luminance(rgb)
    face = gray[max(0, y) : y + h, max(0, x) : x + w]
    none = {"sharpness": None, "asymmetry": None, "residual_ratio": None, "sharpness_ratio": None}
    if face.size == 0 or face.shape[1] < 2:
        return none
    half = face.shape[1] // 2
    out = none | {"sharpness": laplacian_variance(face), "asymmetry": float(abs(face[:, :half].mean() - face[:, -half:].mean()) / 255)}
    top, left = max(0, y - max(8, h // 3)), max(0, x - max(8, w // 3))
    around = gray[top : y + h + max(8, h // 3), left : x + w + max(8, w // 3)]
    outside = np.ones(around.shape, bool)
    outside[max(0, y) - top : y + h - top, max(0, x) - left : x + w - left] = False
    if outside.sum() >= 100:
        res = around - gaussian(around, 1.0)
        lap = np.pad(around, 1, mode="reflect")
        lap = lap[:-2, 1:-1] + lap[2:, 1:-1] + lap[1:-1, :-2] + lap[1:-1, 2:] - 4 * around
        out["residual_ratio"] = float(res[~outside].std() / (res[outside].std() + TINY))
        out["sharpness_ratio"] = float(lap[~outside].var() / (lap[outside].var() + TINY))
    return out
