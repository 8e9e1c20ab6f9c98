"""Review manifests: CSV with embedded JSON, validation, and the detection-dataset export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spoorgrid.operators.chunks import ranked

# Vocabularies of the manual review.
PERSON_LABELS = ("person", "not_person")
MOTION_LABELS = ("moving", "static", "uncertain")


def read_manifest(spark: SparkSession, path: str, schema, json_columns: dict[str, str]) -> DataFrame:
    """CSV manifest; `json_columns` maps a text column to the DDL type it is parsed into."""
    df = spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return df.withColumns({c: F.from_json(c, ddl) for c, ddl in json_columns.items()})


def write_manifest(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """CSV sink; arrays, maps and structs become JSON text."""
    nested = [n for n, t in df.dtypes if t.startswith(("array", "map", "struct"))]
    out = df.withColumns({n: F.to_json(n) for n in nested})
    writer = out.write.mode("overwrite").option("header", True).option("escape", '"')
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)


def box_of(text) -> Column:
    """[x1, y1, x2, y2] with positive width and height, else NULL."""
    box = F.from_json(F.col(text), "array<double>")
    good = (F.size(box) == 4) & (F.get(box, F.lit(2)) > F.get(box, F.lit(0))) & (F.get(box, F.lit(3)) > F.get(box, F.lit(1)))
    return F.when(good & ~F.exists(box, lambda v: v.isNull()), box)


def review_issue(person="person_label", motion="motion_label", instance="instance_id", box="box_json") -> Column:
    """Name of the first field that blocks a row, NULL for a complete one."""
    is_person = F.col(person) == "person"
    return (F.when(~F.col(person).isin(*PERSON_LABELS), "person_label")
            .when(is_person & ~F.col(motion).isin(*MOTION_LABELS), "motion_label")
            .when(is_person & F.col(instance).isin("", "pending"), "instance_id")
            .when(is_person & box_of(box).isNull(), "box_json"))


def require_verified(manifest: DataFrame) -> DataFrame:
    """Strict mode: the first incomplete row stops the job."""
    issue = review_issue()
    guard = F.when(issue.isNull(), F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("unverified row: "), issue)).cast("boolean"))
    return manifest.where(guard)


def dataset_images(manifest: DataFrame, order: str) -> DataFrame:
    """Verified rows with their image id: the position of the row in the whole manifest.

    Positions come from a bucketed running count, so no single task numbers the manifest.
    """
    numbered = ranked(manifest, [], order, [], descending=False, name="image_id")
    paths = F.from_json("paths_json", "array<string>")
    middle = F.get(paths, F.floor(F.size(paths) / 2).cast("int"))
    return numbered.where(review_issue().isNull()).withColumn("file_name", middle)


def detection_annotations(manifest: DataFrame, order: str) -> DataFrame:
    """One annotation per verified person row, with box, area and motion label."""
    people = dataset_images(manifest, order).where(F.col("person_label") == "person")
    people = ranked(people, [], "image_id", [], descending=False, name="annotation_id").withColumn("_b", box_of("box_json"))
    x, y = F.col("_b")[0], F.col("_b")[1]
    w, h = F.col("_b")[2] - x, F.col("_b")[3] - y
    return people.select("annotation_id", "image_id", x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"),
                         (w * h).alias("area"), "sequence", "anchor_frame", "motion_label", "instance_id", "file_name")


def export_detection_dataset(manifest: DataFrame, order: str, path: str, strict: bool = True) -> None:
    """Images, annotations and motion labels as JSON lines, plus the issue list when not strict."""
    rows = require_verified(manifest) if strict else manifest
    images = dataset_images(rows, order).select(
        F.col("image_id").alias("id"), "file_name", "split", "sequence", F.col("anchor_frame").alias("frame_idx"))
    notes = detection_annotations(rows, order)
    images.write.mode("overwrite").json(f"{path}/images")
    notes.select(F.col("annotation_id").alias("id"), "image_id", F.lit(1).alias("category_id"),
                 F.array("x", "y", "w", "h").alias("bbox"), "area", F.lit(0).alias("iscrowd")
                 ).write.mode("overwrite").json(f"{path}/annotations")
    notes.select("image_id", "sequence", F.col("anchor_frame").alias("frame_idx"), "instance_id", "motion_label",
                 F.array("x", "y", F.col("x") + F.col("w"), F.col("y") + F.col("h")).alias("box_xyxy")
                 ).write.mode("overwrite").json(f"{path}/motion_labels")
    issues = manifest.withColumn("issue", review_issue()).where("issue is not null")
    issues.select(order, "issue").write.mode("overwrite").json(f"{path}/issues")
