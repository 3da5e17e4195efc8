"""Scan noise: native sampling of a logged configuration, one pixel function for run and replay."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rng
from ..schemas import NOISE_CONFIG


def noise_fields(key: Column, width: Column, height: Column) -> dict[str, Column]:
    """Every draw as a flat column; angles and limits in fixed decimals, so all engines agree."""
    scaled = lambda name, a, b, unit: (F.lit(a) + rng.h(name, key) % (b - a + 1)) / F.lit(float(unit))
    bright = rng.u("bg_side", key) < 0.5
    out = {f"bg_{c}": F.when(bright, rng.randint(f"bg_{c}", key, 245, 255)).otherwise(rng.randint(f"bg_{c}", key, 0, 10)).cast("int") for c in "bgr"}
    out["texture_seed"] = rng.h("texture", key)
    out["angle"] = scaled("angle", -1500, 1500, 1000)
    for i in range(8):
        out[f"delta_{i}"] = rng.randint(f"delta{i}", key, -5, 10).cast("int")
    for side in "hv":
        on = rng.u(f"{side}_on", key) < 0.7
        out[f"{side}_limit"] = F.when(on, scaled(f"{side}_limit", 700, 900, 1000))
        out[f"{side}_flipped"] = F.when(on, rng.u(f"{side}_flip", key) < 0.5)
    on = rng.u("vignette", key) < 0.333
    out["center_x"] = rng.randint("cx", key, F.floor(width / 3), F.floor(2 * width / 3)).cast("int")
    out["center_y"] = rng.randint("cy", key, F.floor(height / 3), F.floor(2 * height / 3)).cast("int")
    out["strength"] = F.when(on, scaled("strength", 200, 500, 1000))
    out["blur"] = rng.u("blur", key) < 0.5
    return out


def noise_config(key: Column, width: Column, height: Column) -> Column:
    """The same draws as the nested log record."""
    f = noise_fields(key, width, height)
    background = F.array(f["bg_b"], f["bg_g"], f["bg_r"])
    gradient = lambda s: F.struct(f[f"{s}_limit"].isNotNull().alias("applied"), f[f"{s}_limit"].alias("limit"), f[f"{s}_flipped"].alias("flipped"))
    return F.struct(
        background.alias("background_color"),
        F.struct(F.lit(0.5).alias("intensity"), f["texture_seed"].alias("seed")).alias("paper_texture"),
        F.struct(f["angle"].alias("angle"), background.alias("bg_color")).alias("rotation"),
        F.struct(F.lit(10).alias("magnitude"), F.array(*[F.array(f[f"delta_{2 * i}"], f[f"delta_{2 * i + 1}"]) for i in range(4)]).alias("deltas"), background.alias("bg_color")).alias("perspective_transform"),
        F.struct(gradient("h").alias("horizontal_gradient"), gradient("v").alias("vertical_gradient"), F.struct(f["strength"].isNotNull().alias("applied"), F.when(f["strength"].isNotNull(), F.array(f["center_x"], f["center_y"])).alias("center"), f["strength"].alias("strength")).alias("vignette")).alias("lighting_gradient"),
        F.struct(f["blur"].alias("applied")).alias("blur"),
    ).cast(f"struct<{NOISE_CONFIG}>")


def gradient_value(limit: Column, flipped: Column, i: Column, n: int) -> Column:
    """Brightness factor of place i of n: from limit to one, or back."""
    place = F.when(flipped, F.lit(n - 1) - i).otherwise(i)
    return F.coalesce(limit + (1 - limit) * place / F.lit(float(n - 1)), F.lit(1.0))


def vignette_value(x: Column, y: Column, cx: Column, cy: Column, strength: Column, width: int, height: int) -> Column:
    squared = (x - cx) * (x - cx) + (y - cy) * (y - cy)
    factor = 1 - squared / F.lit((width * width + height * height) / 2.0) * strength
    return F.coalesce(F.least(F.greatest(factor, F.lit(0.0)), F.lit(1.0)), F.lit(1.0))


def lighting_mask(h: dict | None, v: dict | None, vignette: dict | None, width: int, height: int) -> np.ndarray:
    mask = np.ones((height, width))
    if h:
        line = h["limit"] + (1 - h["limit"]) * np.arange(width) / max(1, width - 1)
        mask *= line[::-1] if h["flipped"] else line
    if v:
        line = v["limit"] + (1 - v["limit"]) * np.arange(height) / max(1, height - 1)
        mask *= (line[::-1] if v["flipped"] else line)[:, None]
    if vignette:
        x, y = np.meshgrid(np.arange(width), np.arange(height))
        (cx, cy), half = vignette["center"], (width**2 + height**2) / 2
        mask *= np.clip(1 - ((x - cx) ** 2 + (y - cy) ** 2) / half * vignette["strength"], 0, 1)
    return mask


def _sample(image: np.ndarray, x: np.ndarray, y: np.ndarray, background: list[int]) -> np.ndarray:
    """Bilinear samples; places outside have the background."""
    height, width = image.shape[:2]
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    out = np.zeros((*x.shape, 3))
    for dx in (0, 1):
        for dy in (0, 1):
            xi, yi = x0 + dx, y0 + dy
            weight = (1 - np.abs(x - xi)) * (1 - np.abs(y - yi))
            inside = (xi >= 0) & (xi < width) & (yi >= 0) & (yi < height)
            value = np.where(inside[..., None], image[np.clip(yi, 0, height - 1), np.clip(xi, 0, width - 1)], np.asarray(background, float))
            out += weight[..., None] * value
    return out


def _homography(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    rows, values = [], []
    for (x, y), (p, q) in zip(source, target):
        rows += [[x, y, 1, 0, 0, 0, -p * x, -p * y], [0, 0, 0, x, y, 1, -q * x, -q * y]]
        values += [p, q]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(values, float)), 1).reshape(3, 3)


def apply_noise(image: np.ndarray, config: dict) -> np.ndarray:
    """All steps on a BGR image of bytes, each a function of the config alone: the same call runs and replays."""
    height, width = image.shape[:2]
    out = np.clip(image.astype(float) + np.array([-5.0, -2.0, 0.0]), 0, 255)
    texture = config["paper_texture"]
    out = np.clip(out + np.random.default_rng(texture["seed"]).normal(0, 10, image.shape) * texture["intensity"], 0, 255)
    x, y = np.meshgrid(np.arange(width, dtype=float), np.arange(height, dtype=float))
    angle, cx, cy = np.deg2rad(config["rotation"]["angle"]), width // 2, height // 2
    out = _sample(out, np.cos(angle) * (x - cx) - np.sin(angle) * (y - cy) + cx, np.sin(angle) * (x - cx) + np.cos(angle) * (y - cy) + cy, config["rotation"]["bg_color"])
    corners = np.array([[0, 0], [width, 0], [0, height], [width, height]], float)
    moved = corners + np.array(config["perspective_transform"]["deltas"], float)
    p = _homography(moved, corners) @ np.stack([x.ravel(), y.ravel(), np.ones(x.size)])
    out = _sample(out, (p[0] / p[2]).reshape(x.shape), (p[1] / p[2]).reshape(x.shape), config["perspective_transform"]["bg_color"])
    light = config["lighting_gradient"]
    used = lambda k: light[k] if light[k]["applied"] else None
    out *= lighting_mask(used("horizontal_gradient"), used("vertical_gradient"), used("vignette"), width, height)[..., None]
    if config["blur"]["applied"]:
        for axis in (0, 1):  # 3 x 3 binomial kernel
            pad = np.pad(out, [(1, 1) if a == axis else (0, 0) for a in range(3)], mode="reflect" if out.shape[axis] > 1 else "edge")
            size = out.shape[axis]
            out = (pad.take(range(size), axis) + 2 * pad.take(range(1, size + 1), axis) + pad.take(range(2, size + 2), axis)) / 4
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def mask_rectangles(image: np.ndarray, boxes: list[dict], color=(255, 255, 255)) -> np.ndarray:
    """Boxes filled with a colour, both ends included."""
    out = image.copy()
    for b in boxes:
        x, y = int(b["x"]), int(b["y"])
        out[max(0, y) : max(0, int(b["y"] + b["height"]) + 1), max(0, x) : max(0, int(b["x"] + b["width"]) + 1)] = color
    return out


def noisy_images(images: DataFrame) -> DataFrame:
    """id, pixels of images (id, width, height, pixels: raw BGR bytes, config); replay passes the logged config, masks may come as boxes, filled with figure_color (BGR) where that is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            done = []
            for row in rows:
                image = np.frombuffer(row["pixels"], np.uint8).reshape(row["height"], row["width"], 3)
                if row.get("boxes"):
                    image = mask_rectangles(image, row["boxes"], row.get("figure_color") or (255, 255, 255))
                done.append(apply_noise(image, row["config"]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([r["id"] for r in rows], pa.string()), pa.array(done, pa.binary())], names=["id", "pixels"])

    return images.mapInArrow(run, "id string, pixels binary")
