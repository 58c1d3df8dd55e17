"""The timetable as packed arrays: a sink and a source in the app's binary layout, by shards of trips.

A shard is a row whose columns are the little-endian arrays of the layout, so a Parquet reader brings only the arrays that
a query asks for, and only the shards whose range of trips it asks for. ``timetable_file`` and ``paths_file`` join a
shard's arrays into the files that the app reads; ``open_timetable`` and ``open_paths`` take such files apart.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

#: The layout's marks and versions, and what stands for no value.
TIMETABLE, TIMETABLE_VERSION, PATHS, PATHS_VERSION, NONE = b"RGTT", 4, b"RGTP", 1, 0xFFFF
#: The arrays of a timetable file in their order, with their types and whether they have a value for each
#: trip or for each halt; ``start`` has one more than there are trips.
ARRAYS = (("start", "<u4", "trip"), ("station", "<u2", "halt"), ("arr", "<u2", "halt"), ("dep", "<u2", "halt"), ("km", "<u2", "halt"), ("type", "u1", "trip"), ("days", "u1", "trip"), ("approx", "u1", "halt"))
_SHARD = "shard int, lo long, hi long, trips int, halts int, passes int, trip binary, " + ", ".join(f"{n} binary" for n, _, _ in ARRAYS) + ", pass_count binary, pass_station binary"


def _differences(first: np.ndarray, last: np.ndarray, arr: np.ndarray, dep: np.ndarray, km: np.ndarray) -> tuple[np.ndarray, ...]:
    """Arrival from the departure before, departure from the arrival, distance from the one before, all modulo 2^16."""
    back = lambda x: np.where(first, 0, np.roll(x, 1))
    d_arr = np.where(first, 0, arr - back(dep))
    d_dep = np.where(last, 0, np.where(first, dep, dep - arr))
    return tuple(x.astype("<u2") for x in (d_arr & NONE, d_dep & NONE, (km - back(km)) & NONE))


def _sums(start: np.ndarray, d: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The inverse. Within a trip a departure is the sum of all differences up to it, so a running sum that is set
    back at each trip gives all at once."""
    halts = int(start[-1]) if len(start) else 0
    heads = start[:-1].astype(np.int64)
    first, last = np.zeros(halts, bool), np.zeros(halts, bool)
    first[heads], last[start[1:].astype(np.int64) - 1] = True, True

    def run(x: np.ndarray) -> np.ndarray:
        total = np.cumsum(x)
        return total - np.repeat(np.append(0, total)[heads], np.diff(start.astype(np.int64)))

    out = {}
    if "dep" in d:
        upto = run(d["arr"].astype(np.int64) + d["dep"])
        out["dep"] = np.where(last, NONE, upto & NONE)
        out["arr"] = np.where(first, NONE, (upto - d["dep"]) & NONE)
    if "km" in d:
        out["km"] = run(d["km"].astype(np.int64)) & NONE
    return out


def pack(halts: DataFrame, trips: DataFrame, paths: DataFrame, shards: int) -> DataFrame:
    """One row for each shard of trips: their range, counts, and the layout's arrays.

    halts are (trip, seq, station, arr, dep, km, approx), with no arrival at a trip's first halt and no departure at its
    last, and nowhere else; trips are (trip, type, days), paths (trip, after, stations: array) with the stations
    passed behind a halt. Numbers must be below 65,535, types and days below 256: what does not fit is an error, as
    is a trip of halts without a row in trips. A missing distance is that of the halt before. Trips without halts
    are not in the layout. Ranges of trips are dealt to shards by their order, so a shard is one sorted task."""
    ship(halts.sparkSession)
    rows = halts.join(trips.select("trip", "type", "days", F.lit(True).alias("known")), "trip", "left")
    rows = rows.join(paths.select("trip", F.col("after").alias("seq"), F.col("stations").alias("passed")), ["trip", "seq"], "left")
    rows = rows.select("trip", "seq", *[F.col(c).cast("long") for c in ("station", "arr", "dep", "km", "approx", "type", "days")], F.coalesce("known", F.lit(False)).alias("known"), "passed")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        df = pd.concat(held, ignore_index=True)
        trip = df["trip"].to_numpy(np.int64)
        first = np.append(True, trip[1:] != trip[:-1])
        last = np.append(first[1:], True)
        km = df.groupby("trip", sort=False)["km"].ffill().fillna(0)
        number = {c: df[c].fillna(NONE).to_numpy(np.int64) for c in ("station", "arr", "dep", "approx", "type", "days")} | {"km": km.to_numpy(np.int64)}
        for c, x in number.items():
            top = 256 if c in ("approx", "type", "days") else NONE
            gap = {"arr": first, "dep": last}.get(c, np.zeros(len(x), bool))
            bad = np.where(gap, x != NONE, (x < 0) | (x >= top)) | (~df["known"].to_numpy(bool))
            if bad.any():
                raise ValueError(f"trip {trip[bad][0]}: {c} does not fit the layout")
        d_arr, d_dep, d_km = _differences(first, last, number["arr"], number["dep"], number["km"])
        passed = [np.zeros(0, "<u2") if p is None else np.asarray(p, "<u2") for p in df["passed"]]
        heads = np.flatnonzero(first)
        values = {"start": np.append(heads, len(df)), "station": number["station"], "arr": d_arr, "dep": d_dep, "km": d_km, "type": number["type"][heads], "days": number["days"][heads], "approx": number["approx"]}
        row = {"shard": 0, "lo": trip[0], "hi": trip[-1], "trips": len(heads), "halts": len(df), "passes": sum(map(len, passed)), "trip": trip[heads].astype("<i8").tobytes()}
        row |= {n: np.asarray(values[n]).astype(t).tobytes() for n, t, _ in ARRAYS}
        row |= {"pass_count": np.array([len(p) for p in passed], "<u2").tobytes(), "pass_station": np.concatenate(passed).tobytes()}
        yield pd.DataFrame([row])

    dealt = rows.repartitionByRange(shards, "trip").sortWithinPartitions("trip", "seq")
    return dealt.mapInPandas(write, _SHARD).withColumn("shard", F.spark_partition_id())


def unpack(shards: DataFrame, columns: Sequence[str] = ("station", "arr", "dep", "km", "approx", "type", "days")) -> DataFrame:
    """trip, seq and the columns asked for, of every halt in the shards. Only the arrays that these need are read."""
    ship(shards.sparkSession)
    kinds = {"station": "long", "arr": "long", "dep": "long", "km": "long", "approx": "int", "type": "int", "days": "int"}
    need = ["trip", "start", *dict.fromkeys(c for x in columns for c in (("arr", "dep") if x in ("arr", "dep") else (x,)))]
    dtypes = {n: (t, of) for n, t, of in ARRAYS}

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                held = {n: np.frombuffer(row[n], dtypes[n][0]) for n in need if n != "trip"}
                start = held["start"]
                size = np.diff(start.astype(np.int64))
                times = _sums(start, held)
                seq = np.arange(int(start[-1])) - np.repeat(start[:-1].astype(np.int64), size)
                out = {"trip": np.repeat(np.frombuffer(row["trip"], "<i8"), size), "seq": seq}
                for c in columns:
                    x = times.get(c, held[c])
                    x = np.repeat(x, size) if dtypes[c][1] == "trip" else x
                    out[c] = pd.array(x, dtype="Int64")
                    if c in ("arr", "dep"):
                        out[c][x == NONE] = pd.NA
                yield pd.DataFrame(out)

    return shards.select(*need).mapInPandas(read, "trip long, seq long, " + ", ".join(f"{c} {kinds[c]}" for c in columns))


def unpack_paths(shards: DataFrame) -> DataFrame:
    """trip, after, stations: the stations passed behind each halt that has any."""
    ship(shards.sparkSession)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                start, count = np.frombuffer(row["start"], "<u4").astype(np.int64), np.frombuffer(row["pass_count"], "<u2").astype(np.int64)
                trip, size = np.frombuffer(row["trip"], "<i8"), np.diff(start)
                ends = np.cumsum(count)
                station = np.frombuffer(row["pass_station"], "<u2").astype(np.int64)
                at = np.flatnonzero(count)
                seq = np.arange(len(count)) - np.repeat(start[:-1], size)
                yield pd.DataFrame({"trip": np.repeat(trip, size)[at], "after": seq[at], "stations": [station[ends[i] - count[i] : ends[i]] for i in at]})

    return shards.select("trip", "start", "pass_count", "pass_station").mapInPandas(read, "trip long, after long, stations array<long>")


def _le32(x: Column) -> Column:
    """A whole number as four bytes, the lowest first."""
    big = F.unhex(F.lpad(F.hex(x.cast("long")), 8, "0"))
    return F.concat(*[F.substring(big, i, 1) for i in (4, 3, 2, 1)])


def _bytes(raw: bytes) -> Column:
    return F.unhex(F.lit(raw.hex()))


def timetable_file() -> Column:
    """A shard's timetable file."""
    head = F.concat(_bytes(TIMETABLE), _le32(F.lit(TIMETABLE_VERSION)), _le32(F.col("trips")), _le32(F.col("halts")))
    return F.concat(head, *[F.col(n) for n, _, _ in ARRAYS])


def paths_file() -> Column:
    """A shard's paths file."""
    return F.concat(_bytes(PATHS), _le32(F.lit(PATHS_VERSION)), _le32(F.col("halts")), _le32(F.col("passes")), F.col("pass_count"), F.col("pass_station"))


def _number(content: Column, at: int) -> Column:
    part = [F.substring(content, i, 1) for i in range(at + 4, at, -1)]
    return F.conv(F.hex(F.concat(*part)), 16, 10).cast("int")


def _checked(content: Column, mark: bytes, version: int, size: Column) -> Column:
    """The content, or an error if its mark, version or length are not those of the layout."""
    fine = (F.substring(content, 1, 4) == _bytes(mark)) & (_number(content, 4) == version) & (F.octet_length(content) == size)
    return F.when(F.coalesce(fine, F.lit(False)), content).otherwise(F.raise_error(F.lit(f"no {mark.decode()} file of version {version}")))


def open_timetable(files: DataFrame, content: str = "content") -> DataFrame:
    """files with trips, halts and the arrays of each timetable file (a binary column, as of Spark's binaryFile source).
    A file of another mark or version, or cut short, is an error. The numbers of the trips, which the layout leaves to
    the names, must stand beside it in a column ``trip`` before ``unpack``."""
    c, width = F.col(content), {"<u4": 4, "<u2": 2, "u1": 1}
    df = files.withColumns({"trips": _number(c, 8), "halts": _number(c, 12)})
    many = {n: (F.col("trips") + 1 if n == "start" else F.col("trips") if of == "trip" else F.col("halts")) * width[t] for n, t, of in ARRAYS}
    df = df.withColumn(content, _checked(c, TIMETABLE, TIMETABLE_VERSION, sum(many.values(), F.lit(16))))
    out, at = {}, F.lit(17)
    for n, size in many.items():
        out[n], at = F.substr(F.col(content), at, size), at + size
    return df.withColumns(out)


def open_paths(files: DataFrame, content: str = "content") -> DataFrame:
    """files with halts, passes, pass_count and pass_station of each paths file; checked as ``open_timetable``."""
    c = F.col(content)
    df = files.withColumns({"halts": _number(c, 8), "passes": _number(c, 12)})
    df = df.withColumn(content, _checked(c, PATHS, PATHS_VERSION, 16 + 2 * (F.col("halts") + F.col("passes"))))
    size = 2 * F.col("halts")
    return df.withColumns({"pass_count": F.substr(c, F.lit(17), size), "pass_station": F.substr(c, F.lit(17) + size, 2 * F.col("passes"))})
