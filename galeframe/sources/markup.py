"""Bulletins, feeds and placemarks in XML, parsed with declared schemas.

Each parser takes a table with the document text in a column, so any number of
documents is parsed in one job; ``read_*`` helpers use Spark's XML source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from galeframe.functions import text

BULLETIN = (
    "Head struct<Title:string,ReportDateTime:string,TargetDateTime:string>,"
    "Body struct<MeteorologicalInfo:array<struct<DateTime:string,Item:array<struct<"
    "TropicalCyclonePart:struct<Name:string,InternationalNumber:string,Class:string>,"
    "CenterPart:struct<Coordinate:string>,"
    "IntensityPart:struct<CentralPressure:string,MaximumWindSpeed:string>>>>>>"
)


def parse_bulletins(documents: DataFrame, xml: str = "xml") -> DataFrame:
    """Storm bulletins to points; other columns of ``documents`` are kept."""
    keys = [c for c in documents.columns if c != xml]
    return bulletin_points(
        documents.select(*keys, F.from_xml(F.col(xml), BULLETIN).alias("_d")).select(*keys, "_d.*")
    )


def read_bulletins(spark: SparkSession, path: str) -> DataFrame:
    reports = (
        spark.read.format("xml").option("rowTag", "Report").schema(BULLETIN).load(path)
        .select("*", F.col("_metadata.file_name").alias("file"))
    )
    return bulletin_points(reports)


def bulletin_points(reports: DataFrame) -> DataFrame:
    """One row per usable point: the first entry is current, all others forecast.

    Entries without time or readable coordinate are left out; name and number come
    from the first timed entry that has them.
    """
    keys = [c for c in reports.columns if c not in ("Head", "Body")]
    infos = F.col("Body.MeteorologicalInfo")
    timed = F.filter(infos, lambda i: (F.trim(i["DateTime"]) != "") & i["Item"].isNotNull())

    def first_of(name: str, default: str) -> Column:
        named = F.transform(timed, lambda i: text.blank_to_null(F.get(i["Item"], F.lit(0))["TropicalCyclonePart"][name]))
        return F.coalesce(F.get(F.filter(named, lambda n: n.isNotNull()), F.lit(0)), F.lit(default))

    rows = reports.select(
        *keys,
        first_of("InternationalNumber", "unknown").alias("storm_id"),
        first_of("Name", "Unknown").alias("storm_name"),
        F.to_timestamp(text.blank_to_null(F.col("Head.ReportDateTime"))).alias("issue_time"),
        F.posexplode(infos).alias("seq", "i"),
    )
    # Of several items of an information block the first counts.
    item = F.get(F.col("i.Item"), F.lit(0))
    place = item["CenterPart"]["Coordinate"]
    number = lambda c: text.blank_to_null(item["IntensityPart"][c]).try_cast("double")
    return rows.select(
        *keys, "storm_id", "storm_name", F.lit("WP").alias("basin"), F.lit("JMA").alias("source"),
        "issue_time", "seq",
        F.try_to_timestamp(text.blank_to_null(F.col("i.DateTime"))).alias("advisory_time"),
        text.signed_pair_lat(place).alias("lat"),
        text.signed_pair_lon(place).alias("lon"),
        F.when(F.col("seq") == 0, "current").otherwise("forecast").alias("type"),
        number("MaximumWindSpeed").alias("wind_kts"),
        number("CentralPressure").alias("pressure_hpa"),
    ).filter("advisory_time IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")


ATOM_ENTRY = "id string, link struct<_href:string,_VALUE:string>, updated string, title string"


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    return atom_entries(spark.read.format("xml").option("rowTag", "entry").schema(ATOM_ENTRY).load(path))


def parse_atom(documents: DataFrame, xml: str = "xml") -> DataFrame:
    """Feed documents to entries (id, link, updated, title); blanks stay blank."""
    feed = f"entry array<struct<{ATOM_ENTRY.replace(' string', ':string').replace(' struct', ':struct')}>>"
    keys = [c for c in documents.columns if c != xml]
    entries = documents.select(*keys, F.from_xml(F.col(xml), feed).alias("_d")).select(
        *keys, F.explode("_d.entry").alias("e")
    )
    return atom_entries(entries.select(*keys, "e.*"))


def atom_entries(entries: DataFrame) -> DataFrame:
    keys = [c for c in entries.columns if c not in ("id", "link", "updated", "title")]
    tidy = lambda c: F.coalesce(F.trim(c), F.lit(""))
    return entries.select(
        *keys, tidy("id").alias("id"), tidy("link._href").alias("link"),
        tidy("updated").alias("updated"), tidy("title").alias("title"),
    )


# Feed item id -> region.
REGIONS = {
    "NWPAC-NIO-WARNINGS": "WEST PACIFIC",
    "EPAC-CPAC-WARNINGS": "CENTRAL/EAST PACIFIC",
    "SH-WARNINGS": "SOUTHERN HEMISPHERE",
    "TROPICAL-ADVISORIES": "ADVISORIES",
}


def region_table(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{g}', '{n}')" for g, n in REGIONS.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(guid, region)")


RSS = "channel struct<pubDate:string,item:array<struct<guid:string,title:string,description:string>>>"
LINK = r"""(?is)<a\b[^>]*\bhref\s*=\s*["']([^"']*)["']"""


def parse_rss_regions(documents: DataFrame, xml: str = "xml") -> DataFrame:
    """Per feed and region: is a storm active, its title and its links.

    The first item of a region counts; a region without item has null ``active``.
    """
    keys = [c for c in documents.columns if c != xml]
    feeds = documents.select(*keys, F.from_xml(F.col(xml), RSS).alias("_d"))
    regions = F.array(
        *[F.struct(F.lit(g).alias("guid"), F.lit(n).alias("region")) for g, n in REGIONS.items()]
    )
    per_region = feeds.select(*keys, "_d", F.explode(regions).alias("r")).select(
        *keys, "r.guid", "r.region",
        F.get(F.filter("_d.channel.item", lambda i: i["guid"] == F.col("r.guid")), F.lit(0)).alias("i"),
    )
    html = F.coalesce(F.col("i.description"), F.lit(""))
    body = F.trim(text.unescape(F.regexp_replace(html, r"(?s)<[^>]*>", " ")))
    active = F.when(F.col("i").isNotNull(), ~body.contains("No Current Tropical"))
    links = F.regexp_extract_all(html, F.lit(LINK), 1)
    return per_region.select(
        *keys, "guid", "region", active.alias("active"),
        F.when(active, F.trim(F.substring_index(body, "\n", 1))).alias("title"),
        F.when(active, F.filter(links, lambda u: u.endswith(".kmz"))).alias("kmz_links"),
        F.when(
            active, F.filter(links, lambda u: u.contains("web.txt") & ~u.endswith(".kmz"))
        ).alias("text_links"),
    )


_SHAPES = (
    "Point:struct<coordinates:string>,LineString:struct<coordinates:string>,"
    "Polygon:struct<outerBoundaryIs:struct<LinearRing:struct<coordinates:string>>>"
)
PLACEMARK = (
    "struct<name:string,styleUrl:string,description:string,"
    f"{_SHAPES},MultiGeometry:struct<{_SHAPES}>,"
    "ExtendedData:struct<Data:array<struct<_name:string,value:string>>>>"
)
# Comments, character data and tags of a text; what lies between them is text.
XML_TOKEN = r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<[^>]*>|[^<]+|<"
# What a placemark file consists of, in its order: containers that open and close,
# their names, and whole placemarks.
KML_PARTS = (
    r"(?is)<(?:Folder|Document)\b[^>]*(?<!/)>|</(?:Folder|Document)\s*>"
    r"|<Placemark\b[^>]*/>|<Placemark\b.*?</Placemark\s*>|<name\b[^>]*>.*?</name\s*>"
)


def plain_xml(xml: Column) -> Column:
    """A text without comments and prefixes, character data as references.

    Only tags lose prefixes; texts and character data keep every character.  After this
    every ``<`` begins a tag.
    """

    def token(t: Column) -> Column:
        data = F.regexp_extract(t, r"(?s)^<!\[CDATA\[(.*)\]\]>$", 1)
        data = F.replace(F.replace(F.replace(data, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        # A placemark is parsed on its own, where prefixes have no meaning.
        tag = F.regexp_replace(F.regexp_replace(t, r"^<(/?)[\w.-]+:", "<$1"), r"(\s)[\w.-]+:([\w.-]+\s*=)", "$1$2")
        return F.when(~t.startswith("<"), t).when(t.startswith("<!--"), "").when(t.startswith("<![CDATA["), data).otherwise(tag)

    return F.array_join(F.transform(F.regexp_extract_all(xml, F.lit(XML_TOKEN), 0), token), "")


def _parts(xml: str) -> Column:
    return F.regexp_extract_all(plain_xml(F.col(xml)), F.lit(KML_PARTS), 0)


def _parsed(mark: str) -> Column:
    return F.from_xml(mark, StructType.fromDDL(f"p {PLACEMARK}")[0].dataType).alias("p")


def _plain_marks(documents: DataFrame, xml: str) -> DataFrame:
    """Placemarks in document order where folders do not matter: nothing is shuffled."""
    keys = [c for c in documents.columns if c != xml]
    found = F.filter(_parts(xml), lambda part: part.rlike("(?i)^<placemark"))
    # The inner form would have Spark look for empty lists first, with all matching done anew.
    marks = documents.select(*keys, F.posexplode_outer(found).alias("seq", "_xml")).where("seq IS NOT NULL")
    return marks.select(*keys, "seq", _parsed("_xml"))


def _marks(documents: DataFrame, xml: str) -> DataFrame:
    """Placemarks in document order with the nearest named folder, at any depth.

    The parts of a file are rows.  How many containers are open is a running sum; the
    name of a container is the first one since it opened, and a placemark takes the
    innermost of its containers that has one.  Everything is ordered by file and position
    in one shuffle, and its work grows with the number of parts.
    """
    keys = [c for c in documents.columns if c != xml]
    numbered = documents.withColumn("_doc", F.monotonically_increasing_id())
    parts = numbered.select("_doc", *keys, F.posexplode(_parts(xml)).alias("_pos", "_part"))
    part = F.col("_part")
    kind = (
        F.when(part.startswith("</"), "close").when(part.rlike("(?i)^<folder"), "folder").when(part.rlike("(?i)^<document"), "document")
        .when(part.rlike("(?i)^<placemark"), "mark").otherwise("name")
    )
    name = text.blank_to_null(text.unescape(F.regexp_replace(part, r"(?s)^<[^>]*>|<[^<]*>$", "")))
    file = Window.partitionBy("_doc").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("_kind").isin("folder", "document"), 1).when(F.col("_kind") == "close", -1).otherwise(0)
    rows = parts.withColumn("_kind", kind).withColumn("_sum", F.sum(step).over(file))
    # Closing tags without an opening one do not count.
    rows = rows.withColumn("_depth", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(file))).where("_kind <> 'close'")
    # A placemark asks at every level it lies in; its text travels with the innermost.
    levels = F.when(F.col("_kind") == "mark", F.sequence(F.lit(0), F.col("_depth"))).otherwise(F.array("_depth"))
    asked = rows.withColumn("_level", F.explode(levels))
    asked = asked.withColumn("_part", F.when(F.col("_level") == F.col("_depth"), part))
    opens = F.col("_kind").isin("folder", "document")
    level = Window.partitionBy("_doc", "_level").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    asked = asked.withColumns({"_box": F.count_if(opens).over(level), "_folder": F.last(F.when(opens, F.col("_kind") == "folder"), ignorenulls=True).over(level)})
    box = Window.partitionBy("_doc", "_level", "_box").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    named = F.first(F.when(F.col("_folder") & (F.col("_kind") == "name"), name), ignorenulls=True).over(box)
    asked = asked.withColumn("_name", named).where("_kind = 'mark'")
    inner = F.max_by("_name", F.when(F.col("_name").isNotNull(), F.col("_level")))
    marks = asked.groupBy("_doc", "_pos").agg(inner.alias("folder"), F.max("_part").alias("_xml"), *(F.first(F.col(f"`{k}`")).alias(k) for k in keys))
    order = Window.partitionBy("_doc").orderBy("_pos")
    return marks.select(
        *keys, (F.row_number().over(order) - 1).alias("seq"), F.coalesce("folder", F.lit("")).alias("folder"),
        _parsed("_xml"),
    )


def _shape(kind: str) -> tuple[Column, Column]:
    """Is there a geometry of this kind, and its coordinate text."""
    tail = ".outerBoundaryIs.LinearRing.coordinates" if kind == "Polygon" else ".coordinates"
    here, multi = F.col(f"p.{kind}"), F.col(f"p.MultiGeometry.{kind}")
    there = here.isNotNull() | multi.isNotNull()
    return there, F.coalesce(F.col(f"p.{kind}{tail}"), F.col(f"p.MultiGeometry.{kind}{tail}"))


def parse_placemarks(documents: DataFrame, xml: str = "xml") -> DataFrame:
    """Placemark files to rows; a point wins over a line, a line over a polygon."""
    marks = _marks(documents, xml)
    point, line, ring = _shape("Point"), _shape("LineString"), _shape("Polygon")
    kind = F.when(point[0], "Point").when(line[0], "LineString").when(ring[0], "Polygon").otherwise("Unknown")
    spot = F.when(point[0], point[1]).when(line[0], line[1]).when(ring[0], ring[1])
    coords = F.coalesce(
        text.coordinate_list(text.blank_to_null(spot)),
        F.array().cast("array<struct<lat:double,lon:double>>"),
    )
    tidy = lambda c: F.coalesce(F.trim(F.col(f"p.{c}")), F.lit(""))
    keys = [c for c in marks.columns if c not in ("seq", "folder", "p")]
    flat = marks.select(
        *keys, "seq", "folder", tidy("name").alias("name"), tidy("styleUrl").alias("style"),
        kind.alias("geometry"), coords.alias("coords"), tidy("description").alias("description"),
    )
    first = F.when(F.col("geometry") == "Point", F.get("coords", F.lit(0)))
    return flat.withColumns(
        {"lat": first["lat"], "lon": first["lon"], "table": text.html_table(F.col("description"))}
    )


def _ext() -> Column:
    return F.coalesce(
        F.map_from_entries(
            F.transform(
                "p.ExtendedData.Data",
                lambda d: F.struct(d["_name"].alias("key"), F.coalesce(F.trim(d["value"]), F.lit("")).alias("value")),
            )
        ),
        F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")),
    )


def parse_advisory_tracks(documents: DataFrame, xml: str = "xml") -> DataFrame:
    """Track files to rows of kind ``point`` or ``line`` with their metadata map."""
    marks = _plain_marks(documents, xml)
    keys = [c for c in marks.columns if c not in ("seq", "p")]
    point, line = _shape("Point"), _shape("LineString")
    spot = F.get(text.coordinate_list(text.blank_to_null(point[1])), F.lit(0))
    style = F.coalesce(F.trim(F.col("p.styleUrl")), F.lit(""))
    rows = marks.select(*keys, "seq", point[0].alias("_pt"), line[0].alias("_ln"), spot.alias("_at"), style.alias("style"), _ext().alias("ext"))
    points = rows.filter("_pt AND _at IS NOT NULL").select(
        *keys, "seq", F.lit("point").alias("kind"), F.col("_at.lat").alias("lat"), F.col("_at.lon").alias("lon"), "style", "ext"
    )
    none = F.lit(None).cast("double")
    lines = rows.filter(F.col("_ln") & (F.size("ext") > 0)).select(
        *keys, "seq", F.lit("line").alias("kind"), none.alias("lat"), none.alias("lon"), "style", "ext"
    )
    return points.unionByName(lines)


def parse_cones(documents: DataFrame, xml: str = "xml") -> DataFrame:
    """Cone files to ring points: the first placemark with a filled polygon."""
    marks = _plain_marks(documents, xml)
    keys = [c for c in marks.columns if c not in ("seq", "p")]
    ring = text.coordinate_list(text.blank_to_null(_shape("Polygon")[1]))
    rings = marks.select(*keys, "seq", ring.alias("coords")).filter(F.size("coords") > 0)
    first = rings.groupBy(*keys).agg(F.min_by("coords", "seq").alias("coords"))
    return first.select(*keys, F.posexplode("coords").alias("ring_seq", "c")).select(
        *keys, "ring_seq", "c.lat", "c.lon"
    )
