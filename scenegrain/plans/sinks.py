"""Writers: annotation JSON, YOLO text, the pair file, caches, relation exports, audit packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenegrain.functions.geometry import Box, center_form, num
from scenegrain.operators.ranks import placed
from scenegrain.sources.folders import write_per_image
from scenegrain.types import LABEL_IDS, PREDICATE_IDS


def _lookup(ids: dict[str, int], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in ids.items() for x in kv])[key]


def split_of(grp: Column) -> Column:
    return F.when(grp < 5, "train").when(grp == 5, "val").otherwise("test")


def yolo_lines(objs: DataFrame) -> DataFrame:
    """image_id, idx, line: class from 0, centre, width and height with six places; unknown labels are left out."""
    known = objs.withColumn("cls", _lookup(LABEL_IDS, F.col("label")) - 1).where("cls is not null")
    values = [F.round(c, 6) for c in (F.col("cx"), F.col("cy"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))]
    return known.select("image_id", "idx", F.concat(F.col("cls").cast("string"), F.lit(" "), F.format_string("%.6f %.6f %.6f %.6f", *values)).alias("line"))


def write_yolo(objs: DataFrame, path: str) -> None:
    """A line per object under a folder per image, one file each."""
    yolo_lines(objs).select("image_id", "idx", "line").repartition("image_id").sortWithinPartitions("image_id", "idx").select("image_id", F.col("line").alias("value")).write.partitionBy("image_id").text(path)


def annotations(objs: DataFrame, scene: DataFrame, width: int = 1280, height: int = 720) -> DataFrame:
    """One JSON document per image: boxes in both sizes, labels, relations, predicates, flags to review."""
    boxes = lambda longest: F.array(*center_form(Box.of(), F.lit(width), F.lit(height), longest))
    per = objs.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("idx", _lookup(LABEL_IDS, F.col("label")).alias("label"), boxes(1024).alias("b1024"), boxes(512).alias("b512")))).alias("o"))
    pairs = scene.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct(F.col("a_idx").alias("s"), F.col("b_idx").alias("t"), "predicates", "flags"))).alias("p"))
    joined = per.join(pairs, "image_id", "left").withColumn("p", F.coalesce("p", F.array().cast("array<struct<s:int,t:int,predicates:array<string>,flags:array<string>>>")))
    flat = F.flatten(F.transform("p", lambda x: F.transform(x["predicates"], lambda k: F.struct(x["s"].alias("s"), x["t"].alias("t"), _lookup(PREDICATE_IDS, k).alias("k")))))
    doc = F.struct(
        F.lit(width).alias("width"), F.lit(height).alias("height"),
        F.transform("o", lambda x: x["b1024"]).alias("boxes_1024"), F.transform("o", lambda x: x["b512"]).alias("boxes_512"),
        F.transform("o", lambda x: F.array_repeat(F.lit(0), 10)).alias("attribute"), F.transform("o", lambda x: x["label"]).alias("labels"),
        F.transform("r", lambda x: F.array(x["s"], x["t"])).alias("relationships"), F.transform("r", lambda x: x["k"]).alias("predicates"),
        F.transform(F.filter("p", lambda x: F.size(x["flags"]) > 0), lambda x: F.struct(x["s"].alias("subject"), x["t"].alias("object"), x["flags"].alias("flags"))).alias("review_flags"),
    )
    return joined.withColumn("r", flat).select("image_id", F.to_json(doc).alias("value"))


def write_annotations(objs: DataFrame, scene: DataFrame, path: str) -> None:
    """A JSON file per image, in a folder per image below one per group; ids are group/stem, others are put below their grp."""
    names = objs.select("image_id", F.when(F.contains(F.col("image_id").cast("string"), F.lit("/")), F.col("image_id").cast("string")).otherwise(F.concat_ws("/", F.col("grp").cast("string"), F.col("image_id").cast("string"))).alias("name")).distinct()
    write_per_image(annotations(objs, scene).join(names, "image_id").select(F.col("name").alias("image_id"), "value"), path)


def write_pairs_csv(rows: DataFrame, path: str) -> None:
    """The pair file: with header, in order of image, subject and object within each part."""
    rows.sortWithinPartitions("image_id", "subj", "obj").write.option("header", True).option("emptyValue", "").csv(path)


def geometry_documents(objs: DataFrame) -> DataFrame:
    """image_id and value: a list of an image's measured objects, as the cache of one file per image holds it."""
    o = F.struct("idx", "label", F.array("x1", "y1", "x2", "y2").alias("box"), "cx", "cy", "depth", F.array("cx", "cy", "depth").alias("pos3d"))
    return objs.groupBy("image_id").agg(F.sort_array(F.collect_list(o)).alias("o")).select("image_id", F.to_json("o").alias("value"))


def contact_documents(objs: DataFrame, contact: DataFrame) -> DataFrame:
    """image_id and value: contact keyed "i-j" with four places; an image without contact has an empty document, which says that there are masks."""
    per = contact.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("-", "i", "j"), F.bround("frac", 4)))).alias("c"))
    return objs.select("image_id").distinct().join(per, "image_id", "left").select("image_id", F.coalesce(F.to_json("c"), F.lit("{}")).alias("value"))


def result_documents(detections: DataFrame, triplets: DataFrame) -> DataFrame:
    """image_id and value: detections (box_px, label, score) and triplets of an image's result."""
    d = detections.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("det", F.array("x1", "y1", "x2", "y2").alias("box_px"), "label", "score"))).alias("detections"))
    t = triplets.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct(F.col("subj").alias("subject"), "predicate", F.col("obj").alias("object")))).alias("triplets"))
    doc = F.struct("detections", F.coalesce("triplets", F.array().cast("array<struct<subject:int,predicate:string,object:int>>")).alias("triplets"))
    return d.join(t, "image_id", "left").select("image_id", F.to_json(doc).alias("value"))


def markdown(rows: DataFrame, columns: list[str], most: int = 50) -> str:
    """A table of a report's first `most` rows, with how many more there are; a report is of groups, not of rows."""
    n, head = rows.count(), rows.limit(most).collect()
    lines = ["| " + " | ".join(columns) + " |", "|" + "-|" * len(columns)]
    lines += ["| " + " | ".join(f"{v:.3f}" if isinstance(v, float) else str(v) for v in (r[c] for c in columns)) + " |" for r in head]
    return "\n".join(lines + [f"(+{n - len(head)} more)"] * (n > len(head)))


def image_ids(objs: DataFrame) -> DataFrame:
    """split, image_id, id: ids from 0 in each split, in order of image, whatever the type of its id; the split is that of the image's group (grp)."""
    images = objs.select(split_of(F.col("grp")).alias("split"), "image_id").distinct()
    return placed(images, ["split"], ["image_id"], rank="id").select("split", "image_id", "id")


def relation_export(objs: DataFrame, triplets: DataFrame, width: int = 1280, height: int = 720) -> dict[str, DataFrame]:
    """images, annotations, categories, rel_categories and rel_annotations of a relation dataset."""
    spark = objs.sparkSession
    ids = image_ids(objs)
    box = [F.round(c, 2) for c in (F.col("x1") * width, F.col("y1") * height, (F.col("x2") - F.col("x1")) * width, (F.col("y2") - F.col("y1")) * height)]
    return {
        "images": ids.select("split", "id", F.concat(F.col("image_id").cast("string"), F.lit(".png")).alias("file_name"), F.lit(width).alias("width"), F.lit(height).alias("height")),
        "annotations": objs.join(ids, "image_id").select("split", F.col("id").alias("image_id"), "idx", (_lookup(LABEL_IDS, F.col("label")) + 0).alias("category_id"), F.array(*box).alias("bbox"), F.round(box[2] * box[3], 2).alias("area"), F.lit(0).alias("iscrowd")),
        "categories": spark.createDataFrame([(v, k) for k, v in LABEL_IDS.items()], "id int, name string"),
        "rel_categories": spark.createDataFrame([(i + 1, k) for i, k in enumerate(PREDICATE_IDS)], "id int, name string"),
        "rel_annotations": triplets.join(ids, "image_id").select("split", F.col("id").alias("image_id"), "subj", "obj", _lookup({k: i + 1 for i, k in enumerate(PREDICATE_IDS)}, F.col("predicate")).alias("predicate_id")),
    }


def audit_pack(claims: DataFrame, seed: str = "audit") -> tuple[DataFrame, DataFrame]:
    """Blind sheet and key of claims (image_id, subj, predicate, obj, kind): ids follow a seeded shuffle."""
    shuffled = claims.withColumn("id", F.md5(F.concat_ws("|", F.lit(seed), "image_id", "subj", "predicate", "obj")))
    sheet = shuffled.select("id", "image_id", "subj", "predicate", "obj", F.lit("").alias("verdict"), F.lit("").alias("notes"))
    return sheet, shuffled.select("id", "kind", "predicate", "image_id", "subj", "obj")
