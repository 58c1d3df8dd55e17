"""Polygons in shapefiles: .shp holds the rings, .dbf beside it one name for each."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

POINTS = "shape long, name string, ring int, pos int, x double, y double"
#: Fixed values of the format: the file's code, its version, the polygon type, the name's width.
CODE, VERSION, POLYGON, WIDTH = 9994, 1000, 5, 50


def names_of(dbf: bytes) -> list[str]:
    """The first field of each record, without the spaces around it."""
    n, head, size = struct.unpack_from("<IHH", dbf, 4)
    width = dbf[48]
    return [dbf[at + 1 : at + 1 + width].decode("latin-1").strip() for at in range(head, head + n * size, size)]


def rings_of(shp: bytes) -> list[list[np.ndarray] | None]:
    """The rings of each record as arrays of (x, y); None for a record that is no polygon."""
    out: list[list[np.ndarray] | None] = []
    at = 100
    while at + 12 <= len(shp):
        words, kind = struct.unpack_from(">I", shp, at + 4)[0], struct.unpack_from("<i", shp, at + 8)[0]
        if kind == POLYGON:
            parts, points = struct.unpack_from("<ii", shp, at + 44)
            starts = np.frombuffer(shp, "<i4", parts, at + 52)
            out.append(np.split(np.frombuffer(shp, "<f8", 2 * points, at + 52 + 4 * parts).reshape(-1, 2), starts[1:]))
        else:
            out.append(None)
        at += 8 + 2 * words
    return out


def decode(files: DataFrame) -> DataFrame:
    """file, shape (number in the file, from 0), name, ring, pos, x, y of files (file, shp, dbf).

    Records that are no polygons give no rows but count; a shape without a name in the .dbf, or whose .dbf is
    null, has a null name; null .shp content gives nothing. Files are read where they lie, each by one task: the
    format ends at 4 GB, so a large map is many files."""
    ship(files.sparkSession)

    def run(parts):
        for pdf in parts:
            for file, shp, dbf in pdf.itertuples(index=False):
                names = names_of(dbf) if dbf is not None else []
                for i, rings in enumerate(rings_of(shp)):
                    for r, p in enumerate(rings or []):
                        yield pd.DataFrame({"file": file, "shape": i, "name": names[i] if i < len(names) else None, "ring": r, "pos": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1]})

    return files.select(F.col("file").cast("string"), "shp", "dbf").filter("shp is not null").mapInPandas(run, f"file string, {POINTS}")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """decode of all .shp files below a folder, with the .dbf of the same name; file is the name without its ending."""

    def content(ending: str) -> DataFrame:
        found = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{ending}").option("recursiveFileLookup", "true").load(folder)
        return found.select(F.regexp_extract("path", r"(.*)\.\w+$", 1).alias("file"), F.col("content").alias(ending))

    return decode(content("shp").join(content("dbf"), "file", "left"))


def encode(points: DataFrame) -> DataFrame:
    """file, shp, dbf: the files of shapes (file, shape, name, ring, pos, x, y), shapes in the order of their numbers.

    Names are cut at 50 characters of Latin-1, the format's width here; null names are empty. A file is a group."""
    ship(points.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        body, names = [], []
        for n, (_, shape) in enumerate(pdf.sort_values(["shape", "ring", "pos"]).groupby("shape", sort=True)):
            xy, count = shape[["x", "y"]].to_numpy("<f8"), shape.groupby("ring").size().to_numpy()
            starts = np.append(0, np.cumsum(count)[:-1]).astype("<i4")
            content = struct.pack("<i4dii", POLYGON, *xy.min(0), *xy.max(0), len(starts), len(xy)) + starts.tobytes() + xy.tobytes()
            body.append(struct.pack(">II", n + 1, len(content) // 2) + content)
            names.append((shape["name"].iloc[0] or "").encode("latin-1", "replace")[:WIDTH])
        box = (*pdf[["x", "y"]].min(), *pdf[["x", "y"]].max())
        records = b"".join(body)
        shp = struct.pack(">7I", CODE, 0, 0, 0, 0, 0, 50 + len(records) // 2) + struct.pack("<ii4d4d", VERSION, POLYGON, *box, 0, 0, 0, 0) + records
        head = struct.pack("<B3BIHH20x", 3, 95, 7, 26, len(names), 65, WIDTH + 1) + struct.pack("<11sc4xBB14x", b"NAME", b"C", WIDTH, 0) + b"\r"
        dbf = head + b"".join(b" " + n.ljust(WIDTH) for n in names) + b"\x1a"
        return pd.DataFrame({"file": [pdf["file"].iloc[0]], "shp": [shp], "dbf": [dbf]})

    return points.withColumn("file", F.col("file").cast("string")).select("file", "shape", "name", "ring", "pos", "x", "y").groupBy("file").applyInPandas(run, "file string, shp binary, dbf binary")
