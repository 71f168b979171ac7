"""How much a blur hides: digits under a known blur are recovered by trying candidates; flat fill leaves nothing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from sparkveil.sources.shipping import ship

CELL_W, CELL_H = 12, 20
# fixed values: the segments of a seven-segment display that each digit lights (top, upper right, lower right, bottom, lower left, upper left, middle)
SEGMENTS = ("1111110", "0110000", "1101101", "1111001", "0110011", "1011011", "1011111", "1110000", "1111111", "1111011")


def render(digits: str) -> np.ndarray:
    """A row of digits, dark on light, as floats from 0 to 255."""
    out = np.full((CELL_H, CELL_W * len(digits)), 255.0)
    bars = [(slice(2, 4), slice(3, 9)), (slice(3, 10), slice(8, 10)), (slice(10, 17), slice(8, 10)), (slice(16, 18), slice(3, 9)), (slice(10, 17), slice(2, 4)), (slice(3, 10), slice(2, 4)), (slice(9, 11), slice(3, 9))]
    for i, d in enumerate(digits):
        cell = out[:, i * CELL_W : (i + 1) * CELL_W]
        for lit, bar in zip(SEGMENTS[int(d)], bars, strict=True):
            if lit == "1":
                cell[bar] = 0.0
    return out


def gaussian_lines(lines: np.ndarray, sigma: float) -> np.ndarray:
    """Each row under a Gaussian blur; edges repeat."""
    r = int(np.ceil(3 * sigma))
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma**2))
    k /= k.sum()
    return np.apply_along_axis(lambda v: np.convolve(v, k, "valid"), 1, np.pad(lines, [(0, 0), (r, r)], "edge"))


def gaussian(image: np.ndarray, sigma: float) -> np.ndarray:
    """A separable Gaussian blur; edges repeat."""
    return _spread(image.shape[0], sigma).T @ image @ _spread(image.shape[1], sigma)


@lru_cache(maxsize=8)
def _spread(size: int, sigma: float) -> np.ndarray:
    """The blur of a line of ``size`` as a matrix: blur is linear, so a picture is blurred by one product a side."""
    return gaussian_lines(np.eye(size), sigma)


@lru_cache(maxsize=4)
def _candidates(n: int, sigma: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """An empty picture of n places under the blur, what each digit at each place adds to it, the products of these, and their decomposition."""
    shape = (CELL_H, CELL_W * n)
    empty = gaussian(np.full(shape, 255.0), sigma)
    alone = np.empty((n * 10, CELL_H * CELL_W * n))
    for i in range(n):
        for d in range(10):
            picture = np.full(shape, 255.0)
            picture[:, i * CELL_W : (i + 1) * CELL_W] = render(str(d))
            alone[i * 10 + d] = (gaussian(picture, sigma) - empty).ravel()
    u, s, v = np.linalg.svd(alone.T, full_matrices=False)
    held = s > 1e-12 * s[0]
    return empty, alone, alone @ alone.T, (u[:, held], s[held], v[held])


def recover(blurred: np.ndarray, n: int, sigma: float, passes: int = 3) -> str:
    """The digits of one picture."""
    return recover_all(blurred[None], n, sigma, passes)[0]


def recover_all(blurred: np.ndarray, n: int, sigma: float, passes: int = 3) -> list[str]:
    """Digits whose blurred picture is nearest, of each of a stack of pictures: one place after the other, ten candidates each, until nothing changes."""
    if n == 0:
        return [""] * len(blurred)
    empty, alone, products, (u, s, v) = _candidates(n, sigma)
    # a descent from anywhere can end beside the best reading: it begins at the digits that weigh most in
    # the least-squares mixture of all candidates
    seen = blurred.reshape(len(blurred), -1) - empty.ravel()
    guess = ((seen @ u) / s @ v).reshape(-1, n, 10).argmax(axis=2)
    towards, own = seen @ alone.T, products.diagonal().reshape(n, 10)
    for _ in range(passes):
        before = guess.copy()
        for i in range(n):
            # of |rest + digit - seen| squared, what differs between digits
            here = slice(i * 10, i * 10 + 10)
            rest = sum((products[k * 10 + guess[:, k], here] for k in range(n) if k != i), np.zeros((len(guess), 10)))
            guess[:, i] = (2 * (rest - towards[:, here]) + own[i]).argmin(axis=1)
        if (guess == before).all():
            break
    return ["".join(map(str, g)) for g in guess]


#: Pictures that are read side by side.
_STACK = 256


def attack(secrets: DataFrame) -> DataFrame:
    """``secrets`` (id, digits, sigma; sigma 0 for flat fill) with what the attack reads and the part that is right."""
    ship(secrets.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for (n, sigma), same in b.groupby([b["digits"].str.len(), "sigma"], dropna=False):
                n, sigma = int(n), float(sigma)
                for at in range(0, len(same), _STACK):
                    part = same.iloc[at : at + _STACK]
                    if sigma > 0 and n > 0:
                        pictures = _spread(CELL_H, sigma).T @ np.stack([render(d) for d in part["digits"]]) @ _spread(CELL_W * n, sigma)
                    else:
                        pictures = np.full((len(part), CELL_H, CELL_W * n), 18.0)
                    got = recover_all(pictures, n, sigma if sigma > 0 else 4.0)
                    right = [sum(x == y for x, y in zip(g, d, strict=True)) / max(1, n) for g, d in zip(got, part["digits"], strict=True)]
                    yield pd.DataFrame({"id": part["id"].to_numpy(), "recovered": got, "accuracy": right})

    # a table of a few MB is one partition, and each row costs far more than its bytes tell
    dealt = secrets.select("id", "digits", "sigma").repartition(4 * secrets.sparkSession.sparkContext.defaultParallelism, "id")
    return dealt.mapInPandas(run, "id long, recovered string, accuracy double")
