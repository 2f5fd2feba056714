"""Run reports: nested documents to flat image rows and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herdlens.functions.clock import format_iso, micros_between, parse_iso
from herdlens.operators.grouped import join_groups

IMAGE_TIMES = ["weight_prediction_start", "weight_prediction_final"]
ANIMAL_TIMES = ["first_image_capture_time", "last_image_capture_time"]
RUN_TIMES = ["load_model_start", "load_model_final"]
COUNTERS = ["total_of_images", "suitable_images"]
FLAT_COLUMNS = ["pid", *RUN_TIMES, "animal", *ANIMAL_TIMES, "display_time", *COUNTERS, "img", *IMAGE_TIMES]

#: Images of one document: a run of more rows is cut into parts of about so many.
DOCUMENT_ROWS = 100_000


def explode_animals(reports: DataFrame) -> DataFrame:
    """One row per (run, animal), still holding its map of images."""
    run = ["pid", *(parse_iso(c).alias(c) for c in RUN_TIMES)]
    per_animal = reports.select(*run, F.explode("animals").alias("animal", "a"))
    return per_animal.select(
        "pid",
        *RUN_TIMES,
        F.col("animal").cast("int").alias("animal"),
        *(parse_iso(f"a.{c}").alias(c) for c in ANIMAL_TIMES),
        # The animal's own final time is the display time; the image rows have a field of that name too.
        parse_iso("a.weight_prediction_final").alias("display_time"),
        *(F.col(f"a.{c}").alias(c) for c in COUNTERS),
        F.col("a.imgs").alias("imgs"),
    )


def explode_images(animals: DataFrame) -> DataFrame:
    """One row per (run, animal, image); an animal without images has no row."""
    kept = [c for c in animals.columns if c != "imgs"]
    exploded = animals.select(*kept, F.explode("imgs").alias("img", "m"))
    return exploded.select(
        *kept, F.col("img").cast("int").alias("img"), *(parse_iso(f"m.{c}").alias(c) for c in IMAGE_TIMES)
    )


def flatten_reports(reports: DataFrame) -> DataFrame:
    """Documents to flat image rows. Several documents of one run simply add their rows."""
    return explode_images(explode_animals(reports)).select(*FLAT_COLUMNS)


def with_parts(images: DataFrame, every: DataFrame, rows_per_document: int) -> DataFrame:
    """Adds ``part``, the document of its run that an image goes into; NULL where the run is one document.

    ``every`` has the rows that are counted. An animal stays in one part unless it is too long itself. Parts follow the
    hash of animals (of images in a long animal), counted from the first one, so that a run has a part 0.
    """
    counts = every.groupBy("pid", "animal").agg(F.count(F.lit(1)).alias("n"), F.min("img").alias("first_img"))
    per_run = counts.groupBy("pid").agg(F.sum("n").alias("run_n"), F.min("animal").alias("first_animal"))
    sized = join_groups(counts, per_run, ["pid"])

    def pieces(n: str) -> Column:
        return F.ceil(F.col(n) / rows_per_document)

    def away(column: str, first: str) -> Column:
        return F.hash(column).cast("bigint") - F.hash(first)

    marked = sized.select("pid", "animal", "first_img", pieces("n").alias("animal_parts"), pieces("run_n").alias("parts"), away("animal", "first_animal").alias("from"))
    inside = F.pmod(away("img", "first_img"), F.col("animal_parts"))
    part = F.when(F.col("parts") > 1, F.pmod(F.col("from") + inside, F.col("parts"))).cast("int")
    return join_groups(images, marked, ["pid", "animal"]).withColumn("part", part).drop("first_img", "animal_parts", "parts", "from")


def nest_reports(
    rows: DataFrame,
    animals: DataFrame | None = None,
    animals_per_document: int | None = None,
    images_per_document: int | None = None,
    rows_per_document: int = DOCUMENT_ROWS,
) -> DataFrame:
    """Flat image rows to report documents, one for each run; a long run has several, each with its ``part``.

    ``animals`` (as ``explode_animals`` gives them) adds animals that have no image. Of repeated rows of one image the
    one that was predicted last stays, whole. A run of more than ``rows_per_document`` rows is cut into parts (see
    ``with_parts``), and on request by so many animal numbers, and of each so many image numbers; its documents have
    the same ``pid`` and read back as one run.
    """
    columns = [*RUN_TIMES, *ANIMAL_TIMES, "display_time", *COUNTERS]
    every = rows.select("pid", "animal", "img", *columns, *IMAGE_TIMES)
    if animals is not None:
        bare = animals.select("pid", "animal", *columns)
        missing = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("img", *IMAGE_TIMES)]
        every = every.unionByName(bare.select("*", *missing))
    part = ["part", "animal_part", "img_part"]
    placed = {
        "animal_part": F.floor(F.col("animal") / animals_per_document) if animals_per_document else F.lit(0),
        "img_part": F.coalesce(F.floor(F.col("img") / images_per_document), F.lit(0)) if images_per_document else F.lit(0),
    }
    latest = F.max(F.struct("weight_prediction_final", "weight_prediction_start")).alias("times")
    merged = every.groupBy("pid", "animal", "img").agg(
        latest,
        *(F.max(c).alias(c) for c in ["display_time", "last_image_capture_time", *COUNTERS]),
        *(F.min(c).alias(c) for c in ["first_image_capture_time", *RUN_TIMES]),
    )
    # Both groupings below reuse this placement.
    images = with_parts(merged, every, rows_per_document).withColumns(placed).repartition("pid", *part)
    image = F.struct(
        F.col("img").cast("string"), F.struct(*(format_iso(F.col("times")[c]).alias(c) for c in IMAGE_TIMES))
    )
    per_animal = images.groupBy("pid", *part, "animal").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("img").isNotNull(), image))).alias("imgs"),
        *(F.max(c).alias(c) for c in ["display_time", "last_image_capture_time", *COUNTERS]),
        *(F.min(c).alias(c) for c in ["first_image_capture_time", *RUN_TIMES]),
    )
    body = F.struct(
        *(format_iso(c).alias(c) for c in ANIMAL_TIMES),
        format_iso("display_time").alias("weight_prediction_final"),
        *COUNTERS,
        "imgs",
    )
    documents = per_animal.groupBy("pid", *part).agg(
        *(F.min(c).alias(c) for c in RUN_TIMES),
        F.map_from_entries(F.collect_list(F.struct(F.col("animal").cast("string"), body))).alias("animals"),
    )
    return documents.select("pid", *(format_iso(c).alias(c) for c in RUN_TIMES), "animals", "part")


def with_durations(rows: DataFrame) -> DataFrame:
    """Adds the prediction duration of each image and the model load duration, in microseconds."""
    return rows.withColumn(
        "weight_prediction_dur_us", micros_between("weight_prediction_start", "weight_prediction_final")
    ).withColumn("load_model_dur_us", micros_between("load_model_start", "load_model_final"))


def compat_last_image(rows: DataFrame) -> DataFrame:
    """Every row of an animal carries the times of its last image.

    The single-strategy numbers published so far were computed on such rows; use this only to
    reproduce them.
    """
    last = rows.groupBy("pid", "animal").agg(*(F.max_by(c, "img").alias(c) for c in IMAGE_TIMES))
    return join_groups(rows.drop(*IMAGE_TIMES), last, ["pid", "animal"]).select(*rows.columns)
