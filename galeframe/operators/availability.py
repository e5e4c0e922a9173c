"""Forecast hours: segments, availability per product, fetch plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galeframe.functions import text

RUN = ["run_date", "run_hour"]
SEGMENT = "struct<start:int,end:int,step:int>"


def infer_segments(hours: DataFrame, keys: Sequence[str], value: str = "fff") -> DataFrame:
    """Distinct hours to runs of equal step; neighbouring runs share an end point.

    Forecast hours are three-digit numbers, so a key has at most 1000 of them.
    """
    keys = list(keys)
    line = Window.partitionBy(*keys).orderBy(value)
    steps = (
        hours.select(*keys, value).distinct()
        .withColumn("_prev", F.lag(value).over(line))
        .withColumn("_step", F.col(value) - F.col("_prev"))
        .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    )
    changed = F.coalesce(F.col("_step") != F.lag("_step").over(line), F.lit(False))
    runs = steps.withColumn("_run", F.sum(changed.cast("int")).over(line))
    # The first hour has no step of its own and belongs to the first run.
    lone = F.col("_n") == 1
    return (
        runs.filter(F.col("_prev").isNotNull() | lone)
        .groupBy(*keys, "_run")
        .agg(
            F.min(F.coalesce("_prev", value)).alias("start"),
            F.max(value).alias("end"),
            F.coalesce(F.max("_step"), F.lit(1)).alias("step"),
        )
        .select(*keys, "start", "end", "step")
    )


def expand_segments(segments: Column) -> Column:
    """Sorted distinct hours of inclusive (start, end, step) ranges."""
    spans = F.transform(segments, lambda s: F.sequence(s["start"], s["end"], s["step"]))
    return F.array_sort(F.array_distinct(F.flatten(spans)))


def product_requirements(catalog: DataFrame) -> DataFrame:
    """Catalogue rows with required variables and levels."""
    return catalog.select(
        "map_type", "product",
        text.required_names(F.col("query")).alias("required_vars"),
        text.required_levels(F.col("query")).alias("required_levels"),
    )


def product_availability(lines: DataFrame, catalog: DataFrame, mode: str = "loose") -> DataFrame:
    """(map_type, product, run, fff) for which all requirements occur in the index.

    ``loose`` looks for every variable and every level anywhere in the hour's text;
    ``strict`` wants each pair on one line. ``lines`` carry ``line``, ``var`` and
    ``level``; the catalogue is a fixed table of some 15 rows and is broadcast.
    """
    needs = product_requirements(catalog)
    if mode == "strict":
        pairs = needs.select(
            "map_type", "product", F.explode("required_vars").alias("var"), "required_levels",
            (F.size("required_vars") * F.size("required_levels")).alias("_need"),
        ).select("map_type", "product", "var", F.explode("required_levels").alias("level"), "_need")
        hits = (
            lines.select(*RUN, "fff", "var", F.lower("level").alias("level")).distinct()
            .join(F.broadcast(pairs), ["var", "level"])
        )
    else:
        tokens = needs.select(
            "map_type", "product",
            F.concat(
                F.transform("required_vars", lambda v: F.concat(F.lit(":"), v, F.lit(":"))),
                F.transform("required_levels", lambda v: F.concat(F.lit("~"), v)),
            ).alias("_tokens"),
        )
        wanted = tokens.select(F.explode("_tokens").alias("t")).agg(F.array_sort(F.collect_set("t"))).scalar()
        held = lambda t: F.contains(
            F.when(t.startswith("~"), F.lower("line")).otherwise(F.col("line")), F.ltrim(t, F.lit("~"))
        )
        # Only the tokens that a line holds become rows.
        seen = (
            lines.select(*RUN, "fff", "line").withColumn("_wanted", wanted)
            .select(*RUN, "fff", F.explode(F.filter("_wanted", held)).alias("token")).distinct()
        )
        needed = tokens.select(
            "map_type", "product", F.explode("_tokens").alias("token"), F.size("_tokens").alias("_need")
        )
        hits = seen.join(F.broadcast(needed), "token")
    return (
        hits.groupBy(*RUN, "map_type", "product", "fff")
        .agg(F.count(F.lit(1)).alias("_have"), F.max("_need").alias("_need"))
        .filter(F.col("_have") == F.col("_need"))
        .select(*RUN, "map_type", "product", "fff")
    )


def union_hours(available: DataFrame) -> DataFrame:
    """Per run and map the hours at which any product is there (sorted array)."""
    return available.groupBy(*RUN, "map_type").agg(F.array_sort(F.collect_set("fff")).alias("union_fff"))


def availability_document(available: DataFrame, lines: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row per run and map: products with needs, hours and segments, and unions.

    A document holds at most eight products of at most 1000 hours.
    """
    keys = RUN + ["map_type", "product"]
    triple = lambda: F.array_sort(F.collect_list(F.array("start", "end", "step")))
    runs = lines.select(*RUN).distinct()
    existing = (
        lines.select(*RUN, "fff").distinct().groupBy(*RUN)
        .agg(F.array_sort(F.collect_set("fff")).alias("fff_existing"))
        .join(infer_segments(lines, RUN).groupBy(*RUN).agg(triple().alias("fff_existing_segments")), RUN)
    )
    none = F.array().cast("array<int>")
    no_segments = F.array().cast("array<array<int>>")
    hours = available.groupBy(*keys).agg(F.array_sort(F.collect_set("fff")).alias("fff_available"))
    segments = infer_segments(available, keys).groupBy(*keys).agg(triple().alias("segments"))
    # Every run lists every product, also those without an hour.
    listed = product_requirements(catalog).join(
        attach_runs(runs, catalog), ["map_type", "product"]
    )
    products = (
        listed.join(hours, keys, "left").join(segments, keys, "left")
        .groupBy(*RUN, "map_type")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(
            F.col("product"),
            F.struct(
                "required_vars", "required_levels",
                F.coalesce("fff_available", none).alias("fff_available"),
                F.coalesce("segments", no_segments).alias("segments"),
            ).alias("info"),
        )))).alias("products"))
    )
    union_segments = infer_segments(available, RUN + ["map_type"]).groupBy(*RUN, "map_type").agg(
        triple().alias("union_segments")
    )
    return (
        products.join(union_hours(available), RUN + ["map_type"], "left")
        .join(union_segments, RUN + ["map_type"], "left")
        .join(existing, RUN)
        .select(
            *RUN, "map_type", "fff_existing", "fff_existing_segments",
            F.struct(
                "products",
                F.coalesce("union_fff", none).alias("union_fff"),
                F.coalesce("union_segments", no_segments).alias("union_segments"),
            ).alias("map_info"),
        )
    )


def attach_runs(runs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Every run with every product of the catalogue."""
    names = catalog.select(F.struct("map_type", "product").alias("p")).agg(F.collect_list("p")).scalar()
    return runs.select(*runs.columns, F.explode(names).alias("p")).select(*runs.columns, "p.*")


def resolve_hours(requests: DataFrame, available: DataFrame, catalog: DataFrame) -> DataFrame:
    """Hours of each request (run, map_type, mode) with their source.

    ``full`` takes the available hours, else the catalogue's; ``available_only``
    takes the available hours or is invalid; ``init_only`` and ``f00_only`` mean
    hour 0; any other mode takes the catalogue's.
    """
    maps = catalog.groupBy("map_type").agg(F.first("segments").alias("segments"))
    joined = requests.join(F.broadcast(maps), "map_type", "left").join(
        available, RUN + ["map_type"], "left"
    )
    given = F.when(F.size("union_fff") > 0, F.col("union_fff"))
    listed = expand_segments(F.col("segments"))
    mode = F.col("mode")
    hours = (
        F.when(mode == "available_only", given)
        .when(mode == "full", F.coalesce(given, listed))
        .when(mode.isin("init_only", "f00_only"), F.array(F.lit(0)))
        .otherwise(listed)
    )
    from_list = F.when(mode.isin("full", "available_only") & given.isNotNull(), F.lit("available"))
    return joined.select(
        *requests.columns,
        hours.alias("hours"),
        F.when(hours.isNotNull(), F.coalesce(from_list, F.lit("segments"))).alias("fff_source"),
        hours.isNotNull().alias("valid"),
    )


def fetch_plan(resolved: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row per file to fetch, with name and address."""
    products = catalog.select("map_type", "product", "query")
    return (
        resolved.filter("valid")
        .withColumn("fff", F.explode("hours"))
        .join(F.broadcast(products), "map_type")
        .select(
            *[c for c in resolved.columns if c not in ("hours", "valid")], "product", "fff",
            F.concat(
                text.run_file(F.col("run_hour"), F.col("fff")), F.lit("."), F.col("product"), F.lit(".grib2")
            ).alias("file"),
            text.request_url(F.col("run_date"), F.col("run_hour"), F.col("fff"), F.col("query")).alias("url"),
        )
    )


def plan_size(resolved: DataFrame, catalog: DataFrame) -> DataFrame:
    """Files a request comes to: hours times products."""
    products = catalog.groupBy("map_type").agg(F.count(F.lit(1)).alias("n_products"))
    return resolved.join(F.broadcast(products), "map_type").withColumn(
        "n_files", F.coalesce(F.size("hours"), F.lit(0)) * F.col("n_products")
    )


def skip_existing(plan: DataFrame, files: DataFrame, keys: Sequence[str] = ("map_type", "file")) -> DataFrame:
    """Add ``status``: files already there with content are not asked for again."""
    keys = list(keys)
    there = files.filter(F.col("size_bytes") > 0).select(*keys).distinct().withColumn("_there", F.lit(True))
    return plan.join(there, keys, "left").withColumn(
        "status", F.when(F.col("_there"), "skipped_existing").otherwise("to_fetch")
    ).drop("_there")


def valid_requests(requests: DataFrame) -> DataFrame:
    """Add ``valid``: run hour 0..23, known mode, limits in range."""
    return requests.withColumn(
        "valid",
        F.coalesce(
            F.col("run_hour").between(0, 23)
            & F.col("mode").isin("f00_only", "init_only", "full")
            & (F.col("rpm_limit") > 0)
            & (F.col("max_fff") >= 0),
            F.lit(False),
        ),
    )


def first_availability(documents: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hours of the first candidate document that lists any.

    ``documents`` carry ``candidate`` (rank) and ``hours`` (null if unreadable).
    """
    usable = documents.filter(F.size("hours") > 0)
    return usable.groupBy(*keys).agg(
        F.min("candidate").alias("candidate"), F.min_by("hours", "candidate").alias("hours")
    )
