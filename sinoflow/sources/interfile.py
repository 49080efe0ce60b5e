"""Interfile images: a text header and a file of raw numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sinoflow.sources import headers

_KINDS = {("float", 4): "f4", ("float", 8): "f8", ("signed integer", 1): "i1", ("signed integer", 2): "i2", ("signed integer", 4): "i4", ("unsigned integer", 1): "u1", ("unsigned integer", 2): "u2", ("unsigned integer", 4): "u4"}


def image_meta(text: str) -> dict:
    """Sizes and spacings in order z, y, x, number type, offset in bytes, scale and data file of a header."""
    h = headers.header(text)
    of = lambda key, default: [float(h.get(key, {}).get(i, default)) for i in (3, 2, 1)]
    form = h.get("number format", "float").lower()
    form = "float" if "float" in form else form
    width = int(h.get("number of bytes per pixel", 4))
    if (form, width) not in _KINDS:
        raise ValueError(f"number format {form} of {width} bytes")
    order = "<" if "LITTLE" in h.get("imagedata byte order", "LITTLEENDIAN").upper() else ">"
    scale = h.get("image scaling factor", h.get("quantification units", 1))
    offset = h.get("data offset in bytes", 0)
    first = lambda v: v.get(1, 0) if isinstance(v, dict) else v
    return {
        "size": [int(v) for v in of("matrix size", 1)], "spacing": of("scaling factor (mm/pixel)", 1), "origin": of("first pixel offset (mm)", 0),
        "dtype": order + _KINDS[form, width], "offset": int(first(offset)), "scale": float(first(scale) or 1), "file": h.get("name of data file", ""),
    }


def read_image(spark: SparkSession, path: str) -> DataFrame:
    """z, y, x, value of the image whose header is at ``path``. The size of the data file is checked against the header."""
    meta = image_meta(headers.text_of(spark, path))
    at = meta["file"] if "/" in meta["file"] else f"{path.rsplit('/', 1)[0]}/{meta['file']}"
    nz, ny, nx = meta["size"]

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                data = np.frombuffer(content.as_buffer(), meta["dtype"], offset=meta["offset"])
                if len(data) < nz * ny * nx:
                    raise ValueError(f"{len(data)} numbers, the header says {nz} x {ny} x {nx}")
                for z in range(nz):  # a plane at a time
                    plane = data[z * ny * nx : (z + 1) * ny * nx].astype(np.float64) * meta["scale"]
                    y, x = np.divmod(np.arange(ny * nx, dtype=np.int32), np.int32(nx))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(ny * nx, z, np.int32)), pa.array(y), pa.array(x), pa.array(plane)], names=["z", "y", "x", "value"])

    return spark.read.format("binaryFile").load(at).select("content").mapInArrow(run, "z int, y int, x int, value double")


def header_text(size, spacing, file: str) -> str:
    """Header of an image of little-endian floats; size and spacing in order z, y, x."""
    lines = ["!INTERFILE :=", f"name of data file := {file}", "!type of data := PET", "imagedata byte order := LITTLEENDIAN", "!number format := float", "!number of bytes per pixel := 4", "number of dimensions := 3"]
    for i, axis in enumerate("xyz", 1):
        lines += [f"matrix axis label [{i}] := {axis}", f"!matrix size [{i}] := {size[3 - i]}", f"scaling factor (mm/pixel) [{i}] := {spacing[3 - i]}"]
    return "\n".join([*lines, "number of time frames := 1", "!END OF INTERFILE :="]) + "\n"


def write_image(image: DataFrame, path: str, size: tuple[int, int, int], spacing=(1.0, 1.0, 1.0)) -> None:
    """Write z, y, x, value as ``path`` (header, .hv) and its data file (.v) through Spark's file system; missing voxels are 0.

    Planes are packed by the executors and come to the driver one by one.
    """
    spark, (_, ny, nx) = image.sparkSession, size
    spot = F.struct((F.col("y") * nx + F.col("x")).cast("int").alias("i"), F.col("value").cast("float").alias("v"))
    planes = image.groupBy("z").agg(F.collect_list(spot).alias("p")).orderBy("z")  # a plane's size a row
    name = path.rsplit("/", 1)[-1].rsplit(".", 1)[0] + ".v"
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def create(where: str):
        target = jvm.org.apache.hadoop.fs.Path(where)
        return target.getFileSystem(conf).create(target, True)

    out = create(f"{path.rsplit('/', 1)[0]}/{name}")
    try:
        at = 0
        for row in planes.toLocalIterator():
            plane = np.zeros(ny * nx, "<f4")
            plane[[s.i for s in row.p]] = [s.v for s in row.p]
            out.write(bytearray(4 * ny * nx * (row.z - at)) + bytearray(plane.tobytes()))
            at = row.z + 1
        out.write(bytearray(4 * ny * nx * (size[0] - at)))
    finally:
        out.close()
    head = create(path)
    try:
        head.write(bytearray(header_text(size, spacing, name).encode()))
    finally:
        head.close()
