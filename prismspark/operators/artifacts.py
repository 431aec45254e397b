"""Pictures of measures as PNG bytes in a column, and the sink that writes them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismspark.functions import jpeg, pixels, png
from prismspark.operators.images import per_image


def stretched(plane: np.ndarray) -> np.ndarray:
    """A plane over its 1st to 99th percentile, else over its range, else black, in bytes."""
    for low, high in (np.percentile(plane, [1, 99]), (plane.min(), plane.max())):
        if high > low:
            return np.clip((plane - low) / (high - low) * 255, 0, 255).astype(np.uint8)
    return np.zeros(plane.shape, np.uint8)


def pictures(rgb: np.ndarray) -> list[dict]:
    gray = pixels.luminance(rgb)
    made = {
        "ela": stretched(np.abs(rgb.astype(float) - jpeg.recompress(rgb, 90)).mean(axis=2)),
        "noise_residual": stretched(gray - pixels.gaussian(gray, 1.0)),
        "fft_spectrum": stretched(pixels.log_spectrum(gray)),
    }
    tensor = np.fft.fftshift(pixels.upsampling_tensor(rgb), axes=(1, 2))
    for mode, mask in pixels.band_masks(tensor.shape[1]).items():
        made[f"autogan_{mode}"] = np.clip((tensor * mask + 1) * 127.5, 0, 255).astype(np.uint8).transpose(1, 2, 0)
    return [{"artifact": name, "content": png.encode(image)} for name, image in made.items()]


def artifacts(images: DataFrame, key: str = "path") -> DataFrame:
    """key, artifact, content: error level, noise residual, spectrum and the four upsampling bands of each image."""
    return per_image(images, "artifact STRING, content BINARY", pictures, key)


def write_artifacts(rows: DataFrame, folder: str, key: str = "path") -> None:
    """One Parquet folder per kind of artifact, with a file name for each picture."""
    name = F.concat(F.sha2(F.col(key).cast("string"), 256), F.lit(".png"))
    rows.withColumn("file", name).write.mode("overwrite").partitionBy("artifact").parquet(folder)
