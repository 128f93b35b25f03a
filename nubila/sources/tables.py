"""Localization tables, spectra and named results."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nubila.functions.core import ranked

# Column names of localization files, and ours.
NAMES = {
    "id": "id", "frame": "frame", "x [nm]": "x", "y [nm]": "y", "z [nm]": "z", "sigmax [nm]": "sigma_x", "sigmay [nm]": "sigma_y",
    "intensity [photon]": "intensity", "offset [photon]": "offset", "uncertainty [nm]": "uncertainty", "centroid [nm]": "wavelength",
    "bgstd": "bgstd", "z uncertainty": "z_uncertainty", "ydif": "ydif", "centroid2": "centroid2", "fwhm0": "fwhm0", "fwhm1": "fwhm1",
}
WHOLE = {"id": "bigint", "frame": "int"}


def read_localizations(spark: SparkSession, paths: str | Sequence[str], **constants) -> DataFrame:
    """CSV files with a header, by column name; further columns keep their own names; constants add key columns.

    NaN is null. All columns are numbers.
    """
    raw = spark.read.option("header", True).csv(paths)
    value = lambda c: F.expr(f"try_cast(trim(`{c}`) AS DOUBLE)")
    out = raw.select(*[F.when(~F.isnan(value(c)), value(c)).cast(WHOLE.get(NAMES.get(c.strip(), ""), "double")).alias(NAMES.get(c.strip(), c.strip())) for c in raw.columns])
    return out.withColumns({k: F.lit(v) for k, v in constants.items()}) if constants else out


def read_by_position(spark: SparkSession, paths: str | Sequence[str], columns: dict[int, str]) -> DataFrame:
    """Numeric CSV files with one header row, columns named by one-based position."""
    raw = spark.read.option("header", True).csv(paths)
    return raw.select(*[F.expr(f"try_cast(trim(`{raw.columns[i - 1]}`) AS DOUBLE)").alias(n) for i, n in columns.items()])


def read_spectrum(spark: SparkSession, path: str) -> DataFrame:
    """Wavelength (first column) and intensity (third)."""
    return read_by_position(spark, path, {1: "wavelength", 3: "intensity"})


def read_result(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")


def write_result(df: DataFrame, folder: str, name: str, append: bool = False) -> None:
    """One Parquet table for each named result."""
    df.write.mode("append" if append else "overwrite").parquet(f"{folder}/{name}")


def write_localizations(df: DataFrame, path: str, append: bool = False) -> None:
    """CSV with the file's column names."""
    back = {v: k for k, v in NAMES.items()}
    df.select(*[F.col(c).alias(back.get(c, c)) for c in df.columns]).write.mode("append" if append else "overwrite").option("header", True).csv(path)


def write_coordinates(df: DataFrame, path: str, columns: Sequence[str] = ("x", "y", "z")) -> None:
    """Columns separated by blanks, without a header."""
    df.select(*columns).write.mode("overwrite").option("sep", " ").csv(path)


def xyz_lines(df: DataFrame, species: str = "species", transparency: dict[str, float] | None = None, default: float = 0.8, comment: str = "particles") -> DataFrame:
    """Lines of a particle file in order (place, value): count, comment, then species x y z transparency by id."""
    clear = F.lit(default)
    for name, t in (transparency or {}).items():
        clear = F.when(F.col(species) == name, F.lit(t)).otherwise(clear)
    body = df.select(F.col("id").cast("long").alias("place"), F.concat_ws(" ", species, "x", "y", "z", clear.cast("string")).alias("value"))
    head = df.agg(F.count("*").cast("string").alias("value")).select(F.lit(-(1 << 62) - 1).cast("long").alias("place"), "value")
    note = df.sparkSession.range(1).select(F.lit(-(1 << 62)).cast("long").alias("place"), F.lit(comment).alias("value"))
    return head.unionByName(note).unionByName(body)


def write_xyz(df: DataFrame, path: str, **options) -> None:
    """A particle file as text parts that follow each other in order."""
    xyz_lines(df, **options).orderBy("place").select("value").write.mode("overwrite").text(path)


def tiff_pages(pages: DataFrame, width: int, height: int, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """A 16-bit single-page TIFF for each group of pixels (ix, iy, value): keys, tiff. A page is one group."""
    kinds, names = dict(pages.dtypes), list(keys)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        image = np.zeros((height, width), dtype="<u2")
        image[pdf["iy"].to_numpy(int), pdf["ix"].to_numpy(int)] = np.clip(pdf["value"].to_numpy(float), 0, 65535)
        return pd.DataFrame([{k: pdf[k].iloc[0] for k in names} | {"tiff": tiff_bytes(image.tobytes(), width, height)}])

    return pages.select(*keys, "ix", "iy", "value").groupBy(*keys).applyInPandas(one, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", tiff binary")


def tiff_bytes(data: bytes, width: int, height: int, at: int = 8, following: bool = False) -> bytes:
    """A baseline little-endian greyscale TIFF of 16-bit pixels; with `at` over 8 a further page of a file, without the header.

    at: where the page's pixels are in the file. following: whether another page comes right behind its directory.
    """
    # Tag numbers and types of the TIFF 6.0 baseline.
    tags = [(256, 4, width), (257, 4, height), (258, 3, 16), (259, 3, 1), (262, 3, 1), (273, 4, at), (277, 3, 1), (278, 4, height), (279, 4, len(data))]
    entries: Iterator[bytes] = (struct.pack("<HHII", tag, kind, 1, value) for tag, kind, value in tags)
    directory = struct.pack("<H", len(tags)) + b"".join(entries)
    behind = at + len(data) + len(directory) + 4
    page = data + directory + struct.pack("<I", behind + len(data) if following else 0)
    return (b"II*\0" + struct.pack("<I", 8 + len(data)) if at == 8 else b"") + page


def tiff_stacks(pages: DataFrame, width: int, height: int, key: str = "frame", per_file: int = 500) -> DataFrame:
    """Files of up to per_file pages each, in the order of a key, from pixels (key, ix, iy, value): file (from 1), first, pages, tiff.

    The pages' places in the whole order, found without a task that sees them all, say which file they go to; a file is built by one
    task, so per_file pages must fit it. Frames without pixels have no page. Frames are numbered by the place of their key.
    """
    if per_file * (2 * width * height + 114) + 8 >= 1 << 32:
        raise ValueError("a file of this format has less than 4 GB")
    frames = ranked(pages.select(key).distinct(), key, rank="__page")
    placed = pages.select(key, "ix", "iy", F.col("value").cast("double").alias("value")).join(frames, key)
    dealt = placed.select("__page", "ix", "iy", "value", (F.floor((F.col("__page") - 1) / per_file) + 1).cast("long").alias("file"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        first, n = int(pdf["__page"].min()), int(pdf["__page"].nunique())
        images = np.zeros((n, height, width), dtype="<u2")
        images[pdf["__page"].to_numpy(int) - first, pdf["iy"].to_numpy(int), pdf["ix"].to_numpy(int)] = np.clip(pdf["value"].to_numpy(float), 0, 65535)
        parts, at = [], 8
        for k, image in enumerate(images):
            parts.append(tiff_bytes(image.tobytes(), width, height, at, k < n - 1))
            at += len(parts[-1]) - (8 if k == 0 else 0)
        return pd.DataFrame([{"file": pdf["file"].iloc[0], "first": first, "pages": n, "tiff": b"".join(parts)}])

    return dealt.groupBy("file").applyInPandas(build, "file long, first long, pages long, tiff binary")


def tiff_pixels(stacks: DataFrame) -> DataFrame:
    """The pixels over zero of files (file, tiff): file, page (from 1 in its file), ix, iy, value. Directories are followed by their offsets."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for pdf in batches:
            for file, tiff in zip(pdf["file"], pdf["tiff"], strict=True):
                at, page = struct.unpack_from("<I", tiff, 4)[0], 0
                while at:
                    page += 1
                    n = struct.unpack_from("<H", tiff, at)[0]
                    tags = {tag: value for tag, _, _, value in (struct.unpack_from("<HHII", tiff, at + 2 + 12 * k) for k in range(n))}
                    image = np.frombuffer(tiff, "<u2", tags[256] * tags[257], tags[273]).reshape(tags[257], tags[256])
                    iy, ix = np.nonzero(image)
                    yield pd.DataFrame({"file": file, "page": page, "ix": ix.astype("int32"), "iy": iy.astype("int32"), "value": image[iy, ix].astype("int32")})
                    at = struct.unpack_from("<I", tiff, at + 2 + 12 * n)[0]

    return stacks.select("file", "tiff").mapInPandas(read, "file long, page long, ix int, iy int, value int")
