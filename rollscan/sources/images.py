"""Folders of images as tables. Listings read file metadata only; pixels are read where they are asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollscan.staging import sized, stage

SUFFIXES = ("png", "jpg", "jpeg", "bmp", "tif", "tiff")


def natural_key(path: Column) -> Column:
    """A sort key under which digit runs compare as numbers, however long, and the rest lower-cased: a run is preceded by the
    number of its digits."""
    parts = F.split(F.lower(path), r"(?<=\D)(?=\d)|(?<=\d)(?=\D)")
    number = lambda p: F.regexp_replace(p, r"^0+(?=\d)", "")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.concat(F.lpad(F.length(number(p)).cast("string"), 10, "0"), number(p))).otherwise(p)), "")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", "")


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]+$", 1)


def list_files(spark: SparkSession, root: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """path and length of the files under root whose suffix is an image's."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(root)
    return df.select("path", "length").filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*SUFFIXES))


def numbered(files: DataFrame) -> DataFrame:
    """Files with raw_index, their place in natural order in their folder."""
    w = Window.partitionBy(folder(F.col("path"))).orderBy(natural_key(stem(F.col("path"))), "path")
    return files.withColumn("raw_index", (F.row_number().over(w) - 1).cast("long"))


def strided(frames: DataFrame, stride: int, fps: float = 30.0) -> DataFrame:
    """S3: every stride-th frame, numbered anew without gaps; ts_s is from the number before."""
    kept = frames.filter(F.col("raw_index") % stride == 0)
    return kept.withColumns({"frame_index": F.expr(f"raw_index div {stride}"), "ts_s": F.col("raw_index") / F.lit(fps), "stride": F.lit(stride)})


def read_frames(spark: SparkSession, root: str, glob: str = "*.png", stride: int = 1, fps: float = 30.0) -> DataFrame:
    """Frames of a folder with their pixels (BGR). No file is an error, and so is one that cannot be decoded."""
    df = spark.read.format("image").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)
    if df.isEmpty():
        raise FileNotFoundError(f"no file in {root} matches {glob}")
    order = strided(numbered(list_files(spark, root, glob)), stride, fps)
    ok = F.when(F.col("image.height") < 0, F.raise_error(F.concat(F.lit("cannot decode "), F.col("image.origin")))).otherwise(F.lit(True))
    order = stage(order.withColumn("path", F.regexp_replace("path", "^file:/+", "/")), "listing")
    # pixels stay where they are read as long as the counted listing is small
    joined = df.withColumn("path", F.regexp_replace("image.origin", "^file:/+", "/")).join(sized(order), "path")
    return joined.filter(ok).select("path", "frame_index", "ts_s", "stride", "image")


def parse_name(path: Column) -> Column:
    """(number, defect, fabric, clean) of a name nnnn_ddd_ff, null for other names and for masks."""
    s = stem(path)
    part = lambda i: F.regexp_extract(s, r"^(\d+)_(\d+)_(\d+)$", i)
    fits = s.rlike(r"^\d+_\d+_\d+$") & ~F.lower(s).contains("_mask")
    return F.when(fits, F.struct(part(1).cast("int").alias("number"), part(2).alias("defect"), part(3).alias("fabric"), part(2).rlike("^0+$").alias("clean")))


def labelled_images(files: DataFrame) -> DataFrame:
    """Labelled images with the paths of their masks (same stem and _mask, in any folder of the listing). files: path."""
    images = files.withColumn("name", parse_name(F.col("path"))).filter("name IS NOT NULL").select("path", stem(F.col("path")).alias("stem"), "name.*")
    masks = files.select(F.col("path").alias("mask"), stem(F.col("path")).alias("m")).filter(F.lower("m").contains("_mask"))
    masks = masks.withColumn("stem", F.regexp_extract("m", r"(?i)^(.*?)_mask", 1)).groupBy("stem").agg(F.array_sort(F.collect_list("mask")).alias("mask_paths"))
    return images.join(masks.hint("merge"), "stem", "left").withColumn("mask_paths", F.coalesce("mask_paths", F.array().cast("array<string>")))


def split_folders(files: DataFrame) -> DataFrame:
    """Images of category/{train,test}/type/name with their mask in ground_truth/type/name_mask; defective = type is not good.
    A good image has no mask (all zero)."""
    at = lambda i: F.regexp_extract("path", r"([^/]+)/(train|test|ground_truth)/([^/]+)/[^/]+$", i)
    f = files.select("path", at(1).alias("category"), at(2).alias("split"), at(3).alias("type"), stem(F.col("path")).alias("stem")).filter("category <> ''")
    masks = f.filter("split = 'ground_truth'").select("category", "type", F.regexp_replace("stem", "_mask$", "").alias("stem"), F.col("path").alias("mask"))
    images = f.filter("split <> 'ground_truth'").withColumn("defective", F.col("type") != "good")
    joined = images.join(masks.withColumn("split", F.lit("test")), ["category", "split", "type", "stem"], "left")
    w = Window.partitionBy("category", "split").orderBy("type", "stem")
    return joined.withColumn("place", F.row_number().over(w))


def clean_images(files: DataFrame) -> DataFrame:
    """Images of a folder of clean frames, masks left out, in natural order."""
    return numbered(files.filter(~F.lower(stem(F.col("path"))).endswith("_mask")))


def cells(frames: DataFrame, keys: list[str], channel: int | None = None) -> DataFrame:
    """Pixels of 8-bit images as cells (keys, y, x, value): one channel, or their mean. The image's bytes are spread by sequence, row by row."""
    i = F.col("image")
    rows = frames.select(*keys, "image", F.explode(F.sequence(F.lit(0), i.height - 1)).alias("y"))
    n = F.col("image.nChannels")
    line = F.hex(F.substring("image.data", F.col("y") * F.col("image.width") * n + 1, F.col("image.width") * n))
    px = rows.select(*keys, "y", n.alias("n"), F.posexplode(F.regexp_extract_all(line, F.lit("(..)"), F.lit(1))).alias("at", "byte"))
    px = px.select(*keys, "y", F.expr("at div n").cast("int").alias("x"), (F.col("at") % F.col("n")).alias("c"), F.conv("byte", 16, 10).cast("double").alias("v"))
    return (px.filter(F.col("c") == channel) if channel is not None else px).groupBy(*keys, "y", "x").agg(F.avg("v").alias("value"))
