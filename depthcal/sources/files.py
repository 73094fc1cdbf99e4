"""Readers and writers of the file formats. Paths may lie in any store that Spark reads."""

from __future__ import annotations

import io
import json
import os
import re
import subprocess
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.scalar import flat_name, frame_file, general_format, parse_rate

VIDEO_SUFFIX = r"(?i)\.(avi|mp4|mov)$"


def _csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """A CSV file with ``ord``, the order of its rows: file, offset of the split, place in the split."""
    rows = spark.read.schema(schema).csv(path, header=True, nullValue="", enforceSchema=False)
    return rows.withColumn("ord", F.struct(F.col("_metadata.file_name"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))


def first_rows(df: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` rows in file order."""
    return df if n is None else df.orderBy("ord").limit(n)


def read_annotations(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    return first_rows(_csv(spark, path, schemas.ANNOTATIONS), limit)


def as_evaluation_rows(annotations: DataFrame) -> DataFrame:
    return annotations.withColumnRenamed("distance", "distance_gt")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Results; blanks and the word None are missing."""
    rows = spark.read.csv(path, header=True, nullValue="")
    out = []
    for f in schemas.RESULTS.fields:
        text = F.col(f.name) if f.name in rows.columns else F.lit(None).cast("string")
        out.append(F.when((text == "") | (text == "None"), None).otherwise(text).cast(f.dataType).alias(f.name))
    order = F.struct(F.col("_metadata.file_name"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("ord")
    return rows.select(*out, order)


def read_fps(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.VIDEO_FPS).csv(path, header=True, nullValue="", enforceSchema=False)


def read_exclusions(spark: SparkSession, path: str) -> DataFrame:
    """Distinct (video_name, frame_idx) of a flags file; a frame that isn't a whole number is an error."""
    rows = spark.read.csv(path, header=True, nullValue="")
    return rows.select("video_name", F.col("frame_idx").cast("int").alias("frame_idx")).distinct()


def write_csv(df: DataFrame, path: str) -> None:
    """One header for each part, missing values as blanks; nested columns must have been turned into text."""
    df.drop("ord").write.mode("overwrite").csv(path, header=True, nullValue="")


def write_results(results: DataFrame, path: str) -> None:
    """The columns of the results file, in its order."""
    write_csv(results.select(*schemas.RESULTS.fieldNames()), path)


def list_videos(spark: SparkSession, root: str) -> DataFrame:
    """Paths below ``root`` that name a video, in order. Only the path is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path").where(F.col("path").rlike(VIDEO_SUFFIX)).orderBy("path")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(path, h, w, depth) of .npy maps; 16-bit values become 32-bit ones."""
    def load(batches):
        for pdf in batches:
            maps = [np.load(io.BytesIO(c), allow_pickle=False) for c in pdf["content"]]
            yield pd.DataFrame({"path": pdf["path"], "h": [m.shape[0] for m in maps], "w": [m.shape[1] for m in maps], "depth": [m.astype(np.float32).ravel() for m in maps]})

    return _files(spark, path).mapInPandas(load, schemas.DEPTH_MAPS)


def npy_bytes(depth, h: int, w: int, kind: str = "float32") -> bytes:
    out = io.BytesIO()
    np.save(out, np.asarray(depth, np.float64).reshape(h, w).astype(kind))
    return out.getvalue()


def put_file(folder: str, name: str, data: bytes) -> None:
    """Write a file below a folder, a mounted one or one of a store's URI. It appears whole, and a repeated task replaces it."""
    if "://" in folder and not folder.startswith("file:"):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/{name}") as out:
            out.write(data)
        return
    root = folder.removeprefix("file://").removeprefix("file:")
    os.makedirs(root, exist_ok=True)
    passing = os.path.join(root, f".{name}.{os.getpid()}")
    with open(passing, "wb") as f:
        f.write(data)
    os.replace(passing, os.path.join(root, name))


def write_npy(maps: DataFrame, folder: str, kind: str = "float32") -> DataFrame:
    """Write (name, h, w, depth) rows as files; returns their names."""
    def save(batches):
        for pdf in batches:
            for name, h, w, depth in zip(pdf["name"], pdf["h"], pdf["w"], pdf["depth"], strict=True):
                put_file(folder, name, npy_bytes(depth, h, w, kind))
            yield pdf[["name"]]

    return maps.select("name", "h", "w", "depth").mapInPandas(save, "name string")


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Write (name, content) rows as files; returns their names."""
    def save(batches):
        for pdf in batches:
            for name, content in zip(pdf["name"], pdf["content"], strict=True):
                put_file(folder, name, bytes(content))
            yield pdf[["name"]]

    return rows.select("name", "content").mapInPandas(save, "name string")


def write_masks(frames: DataFrame, folder: str) -> DataFrame:
    """Write one JSON file for each frame (video_name, frame_idx, instances); returns their names. ``instances``: structs
    of center_xy, area_px and rle in the order of their place, which becomes instance_idx."""
    numbered = F.transform("instances", lambda m, i: F.struct(i.alias("instance_idx"), m["center_xy"].alias("center_xy"), m["area_px"].alias("area_px"), m["rle"].alias("rle")))
    return write_files(frames.select(frame_file(F.col("video_name"), F.col("frame_idx"), "masks.json").alias("name"), masks_json(numbered).cast("binary").alias("content")), folder)


def write_pairs(pairs: DataFrame, folder: str) -> DataFrame:
    """Write a paired export (path of the map, video_name, frame_idx, h, w, pixels): the map's file unchanged below
    ``depth_maps``, the frame as PNG below ``frames``; returns the names."""
    from ..operators.panels import png

    spark = pairs.sparkSession
    paths = [r["path"] for r in pairs.select(F.regexp_replace("path", "/[^/]*$", "").alias("path")).distinct().collect()]  # one row for each folder of maps
    if not paths:
        return spark.createDataFrame([], "name string")
    contents = spark.read.format("binaryFile").load(paths).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content")
    rows = pairs.withColumn("path", F.regexp_replace("path", "^file:/+", "/")).join(contents, "path")

    def save(batches):
        for pdf in batches:
            for path, stem, h, w, pixels, content in zip(pdf["path"], pdf["stem"], pdf["h"], pdf["w"], pdf["pixels"], pdf["content"], strict=True):
                image = np.clip(np.rint(np.asarray(pixels, float)), 0, 255).astype(np.uint8).reshape(int(h), int(w), -1)
                put_file(f"{folder}/frames", f"{stem}.png", png(np.repeat(image, 3, 2) if image.shape[2] == 1 else image))
                put_file(f"{folder}/depth_maps", path.rsplit("/", 1)[1], bytes(content))
            yield pd.DataFrame({"name": pdf["stem"]})

    stem = F.format_string("%s_frame%06d", "video_name", F.col("frame_idx").cast("int"))
    return rows.select("path", stem.alias("stem"), "h", "w", "pixels", "content").mapInPandas(save, "name string")


def read_masks(spark: SparkSession, path: str) -> DataFrame:
    """(path, instances) of mask files, one JSON array each."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", schemas.MASKS).alias("instances"))


def masks_json(instances: Column) -> Column:
    return F.to_json(instances)


def _cells(content: bytes, sheet: str) -> list[tuple[str | None, ...]]:
    """Rows of the named sheet of a workbook, cells as text, by column letters."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        ids = {s.get("name"): s.get(rel) for s in book.find("m:sheets", ns)}
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        tree = ElementTree.fromstring(z.read("xl/" + targets[ids[sheet]].removeprefix("/xl/")))
        rows = []
        for row in tree.iter(f"{{{ns['m']}}}row"):
            cells = {}
            for c in row.findall("m:c", ns):
                value, kind = c.find("m:v", ns), c.get("t")
                text = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t")) if kind == "inlineStr" else None if value is None else value.text
                cells["".join(ch for ch in c.get("r") if ch.isalpha())] = shared[int(text)] if kind == "s" and text is not None else text
            rows.append((cells.get("A"), cells.get("B")))
        return rows


def read_video_list(spark: SparkSession, path: str, data_dir: str = "", sheet: str = "Sheet1") -> DataFrame:
    """(anno, ori, row) of the workbook; its header must be (ori, anno), rows without a name are left out."""
    def parse(batches):
        for pdf in batches:
            for content in pdf["content"]:
                rows = _cells(content, sheet)
                if not rows or rows[0] != ("ori", "anno"):
                    raise ValueError(f"the header is {rows[:1]}, not (ori, anno)")
                yield pd.DataFrame([(a, f"{data_dir.rstrip('/')}/{o}" if data_dir else o, i) for i, (o, a) in enumerate(rows[1:]) if a is not None], columns=["anno", "ori", "row"])

    return _files(spark, path).mapInPandas(parse, "anno string, ori string, row long")


Prober = Callable[[str], dict]


def ffprobe(path: str) -> dict:
    """Rates, duration and frames of the first video stream as text, by the external tool; within a minute."""
    command = ["ffprobe", "-v", "error", "-select_streams", "v:0", "-show_entries", "stream=r_frame_rate,avg_frame_rate,duration,nb_frames", "-of", "json", path]
    found = json.loads(subprocess.run(command, capture_output=True, timeout=60, check=True).stdout)
    stream = found["streams"][0]
    return {"fps": stream.get("r_frame_rate"), "avg_fps": stream.get("avg_frame_rate"), "nb_frames": stream.get("nb_frames"), "duration_s": stream.get("duration")}


def probe_videos(videos: DataFrame, prober: Prober = ffprobe) -> DataFrame:
    """(path, fps, avg_fps, duration_s, nb_frames, vfr); a video that can't be probed has missing values."""
    def run(batches):
        for pdf in batches:
            rows = []
            for path in pdf["path"]:
                try:
                    rows.append({"path": path, **prober(path)})
                except Exception:  # one bad video doesn't end the listing
                    rows.append({"path": path})
            yield pd.DataFrame(rows, columns=["path", "fps", "avg_fps", "nb_frames", "duration_s"]).astype(object).where(lambda x: x.notna(), None)

    raw = videos.select("path").mapInPandas(run, "path string, fps string, avg_fps string, nb_frames string, duration_s string")
    out = raw.select("path", parse_rate(F.col("fps")).alias("fps"), parse_rate(F.col("avg_fps")).alias("avg_fps"), F.col("duration_s").try_cast("double").alias("duration_s"), "nb_frames")
    return out.withColumn("vfr", F.coalesce(F.abs(F.col("fps") - F.col("avg_fps")) > 0.01, F.lit(False)))


def fps_rows(probed: DataFrame, root: str) -> DataFrame:
    """The rows of the rate table: names flattened below ``root``, numbers as six significant digits of text."""
    below = F.regexp_replace("path", "^" + re.escape(root.rstrip("/")) + "/", "")
    text = [F.when(F.col(c).isNotNull(), general_format(F.col(c))).alias(c) for c in ("fps", "avg_fps", "duration_s")]
    return probed.select(flat_name(below).alias("video_name"), below.alias("path"), *text, "nb_frames", "vfr")


#: Opens a video and yields its frames in order; raises OSError where it can't be opened.
Decoder = Callable[[str], Iterator[np.ndarray]]


def frames_at(decode: Decoder, path: str, wanted) -> Iterator[tuple[int, np.ndarray | None]]:
    """(index, frame) of the wanted frames in ascending order, each once; None past the end; no frame behind the last
    wanted one is decoded."""
    left = sorted({int(i) for i in wanted})
    if not left:
        return
    stream = enumerate(decode(path))
    for k in left:
        frame = next((f for i, f in stream if i == k), None)
        yield k, frame


def read_frames(wanted: DataFrame, decode: Decoder) -> DataFrame:
    """(path, frame_idx, h, w, pixels, status) of the wanted (path, frame_idx); one task call for each video."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        path, rows = pdf["path"].iloc[0], []
        try:
            for i, f in frames_at(decode, path, pdf["frame_idx"]):
                rows.append((path, i, None, None, None, "frame_decode_error") if f is None else (path, i, f.shape[0], f.shape[1], np.asarray(f, float).ravel(), None))
        except OSError as e:
            rows = [(path, int(i), None, None, None, f"video_error: {e}") for i in sorted(set(pdf["frame_idx"]))]
        return pd.DataFrame(rows, columns=["path", "frame_idx", "h", "w", "pixels", "status"]).astype({"h": "Int32", "w": "Int32"})

    return wanted.select("path", "frame_idx").groupBy("path").applyInPandas(run, "path string, frame_idx int, h int, w int, pixels array<double>, status string")
