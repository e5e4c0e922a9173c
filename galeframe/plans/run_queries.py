"""Queries over index lines, runs, files and feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from galeframe import sinks
from galeframe.functions import classify, text
from galeframe.operators import availability as av
from galeframe.operators import feeds, files
from galeframe.plans import views
from galeframe.plans.registry import query
from galeframe.plans.views import (
    BULLETIN_SQL,
    ENTRIES_SQL,
    FILES_SQL,
    LINES_SQL,
    REQUEST_SQL,
    table,
)
from galeframe.session import scratch_dir
from galeframe.sources import documents, listings, markup
from galeframe.sources.catalog import PRODUCTS, SEGMENTS, map_catalog

REQUIRED = ", ".join(
    f"('{m}', '{p}', {n}, '{kind}', '{tok}')"
    for m, p, level, variables in PRODUCTS
    for n in [1 + len(variables)]
    for kind, tok in [("l", level.replace("_", " ")), *[("v", v) for v in variables]]
)
REQ_SQL = f"req(map_type, product, need, kind, tok) AS (VALUES {REQUIRED})"
QUERY_TEXT = ", ".join(
    f"('{m}', '{p}', '{'&'.join([f'lev_{lv}=on', *[f'var_{v}=on' for v in vs]])}')" for m, p, lv, vs in PRODUCTS
)
CAT_SQL = f"cat(map_type, product, qs) AS (VALUES {QUERY_TEXT})"
SEG_SQL = "seg(map_type, hs) AS (VALUES " + ", ".join(
    f"('{m}', list_sort(list_distinct(flatten([{', '.join(f'range({a},{b + 1},{c})' for a, b, c in spans)}]))))"
    for m, spans in SEGMENTS.items()
) + ")"


def lines(spark, sf):
    return listings.index_lines(views.index_text(spark, sf))


@query("scan_idx_lines", f"WITH {LINES_SQL} SELECT run_hour, fff, var, level, line FROM idx")
def _(spark, sf):
    return lines(spark, sf).select("run_hour", "fff", "var", "level", "line")


@query(
    "map_catalog",
    f"WITH {LINES_SQL}, {REQ_SQL} SELECT map_type, product, count(idx.line) AS n_lines FROM req LEFT JOIN idx ON kind='v' AND var=tok GROUP BY 1, 2",
)
def _(spark, sf):
    """Catalogue products with the number of index lines of their variables."""
    needs = av.product_requirements(map_catalog(spark))
    wanted = needs.select("map_type", "product", F.explode("required_vars").alias("var"))
    per_var = lines(spark, sf).groupBy("var").agg(F.count(F.lit(1)).alias("n"))
    counted = wanted.join(per_var, "var", "left").groupBy("map_type", "product")
    return counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_lines"))


@query(
    "extract_requirements",
    f"WITH {REQUEST_SQL}, {REQ_SQL}, r AS (SELECT map_type, product, string_agg(tok, ',' ORDER BY tok) FILTER (kind='v') AS vars, "
    "string_agg(tok, ',' ORDER BY tok) FILTER (kind='l') AS levels FROM req GROUP BY 1, 2) "
    "SELECT request_id, product, vars, levels FROM rq JOIN r USING (map_type)",
)
def _(spark, sf):
    asked = views.requests(spark, sf).join(F.broadcast(map_catalog(spark)), "map_type")
    names = lambda c: F.array_join(F.array_sort(c), ",")
    return asked.select(
        "request_id", "product",
        names(text.required_names(F.col("query"))).alias("vars"),
        names(text.required_levels(F.col("query"))).alias("levels"),
    )


LOOSE_SQL = (
    "hrs AS (SELECT run_hour, fff, string_agg(line, chr(10)) AS txt FROM idx GROUP BY 1, 2), "
    "hits AS (SELECT run_hour, map_type, product, fff, CASE WHEN kind='v' THEN contains(txt, concat(':',tok,':')) "
    "ELSE contains(lower(txt), tok) END AS ok FROM hrs, req), "
    "loose AS (SELECT run_hour, map_type, product, fff FROM hits GROUP BY ALL HAVING bool_and(ok))"
)
STRICT_SQL = (
    "pairs AS (SELECT v.map_type, v.product, v.tok AS var, l.tok AS level FROM req v JOIN req l USING (map_type, product) "
    "WHERE v.kind='v' AND l.kind='l'), need AS (SELECT map_type, product, count(*) AS n FROM pairs GROUP BY 1, 2), "
    "strict AS (SELECT run_hour, map_type, product, fff FROM (SELECT DISTINCT run_hour, fff, var, lower(level) AS level FROM idx) "
    "JOIN pairs USING (var, level) JOIN need USING (map_type, product) GROUP BY run_hour, map_type, product, fff, n HAVING count(*)=n)"
)


@query(
    "product_availability",
    f"WITH {LINES_SQL}, {REQ_SQL}, {LOOSE_SQL}, {STRICT_SQL} SELECT *, 'loose' AS mode FROM loose UNION ALL SELECT *, 'strict' FROM strict",
)
def _(spark, sf):
    both = [
        av.product_availability(lines(spark, sf), map_catalog(spark), m).withColumn("mode", F.lit(m))
        for m in ("loose", "strict")
    ]
    return both[0].unionByName(both[1]).select("run_hour", "map_type", "product", "fff", "mode")


def hour_text(column):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")


@query(
    "union_fff",
    f"WITH {LINES_SQL}, {REQ_SQL}, {LOOSE_SQL}, d AS (SELECT DISTINCT run_hour, map_type, fff FROM loose) "
    "SELECT run_hour, map_type, string_agg(fff, ',' ORDER BY fff) AS union_fff FROM d GROUP BY 1, 2",
)
def _(spark, sf):
    found = av.union_hours(av.product_availability(lines(spark, sf), map_catalog(spark)))
    return found.select("run_hour", "map_type", hour_text("union_fff").alias("union_fff"))


def segments_sql(source: str, keys: str) -> str:
    return (
        f"d1 AS (SELECT DISTINCT {keys}, fff FROM {source}), "
        f"d2 AS (SELECT *, lag(fff) OVER (PARTITION BY {keys} ORDER BY fff) AS p, count(*) OVER (PARTITION BY {keys}) AS n FROM d1), "
        f"d3 AS (SELECT *, fff-p AS st, CASE WHEN fff-p<>lag(fff-p) OVER (PARTITION BY {keys} ORDER BY fff) THEN 1 ELSE 0 END AS ch FROM d2), "
        f"d4 AS (SELECT *, sum(ch) OVER (PARTITION BY {keys} ORDER BY fff) AS run FROM d3), "
        f"segs AS (SELECT {keys}, min(coalesce(p,fff)) AS start, max(fff) AS \"end\", coalesce(max(st),1) AS step FROM d4 "
        f"WHERE p IS NOT NULL OR n=1 GROUP BY {keys}, run)"
    )


@query(
    "infer_segments",
    f"WITH h AS (SELECT p_brand, CAST(p_partkey%385 AS INT) AS fff FROM part), {segments_sql('h', 'p_brand')} "
    'SELECT p_brand, start, "end", step FROM segs',
)
def _(spark, sf):
    hours = table(spark, sf, "part").selectExpr("p_brand", "CAST(p_partkey%385 AS INT) AS fff")
    return av.infer_segments(hours, ["p_brand"])


@query(
    "expand_segments",
    "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(range(p_size,p_size+11,3),range(p_size+8,p_size+21,4)))),',') AS hours FROM part",
)
def _(spark, sf):
    spans = (
        "array(named_struct('start', p_size, 'end', p_size+10, 'step', 3), "
        "named_struct('start', p_size+8, 'end', p_size+20, 'step', 4)) AS segments"
    )
    rows = table(spark, sf, "part").selectExpr("p_partkey", spans)
    return rows.select("p_partkey", hour_text(av.expand_segments(F.col("segments"))).alias("hours"))


RESOLVED_SQL = (
    f"{REQUEST_SQL}, {SEG_SQL}, un AS (SELECT run_date, run_hour, map_type, list_sort(list(fff)) AS hs FROM av GROUP BY 1, 2, 3), "
    "rs AS (SELECT rq.*, CASE mode WHEN 'available_only' THEN un.hs WHEN 'full' THEN coalesce(un.hs, seg.hs) WHEN 'init_only' THEN [0] "
    "WHEN 'f00_only' THEN [0] ELSE seg.hs END AS hours, CASE WHEN mode IN ('full','available_only') AND un.hs IS NOT NULL THEN 'available' "
    "WHEN mode='available_only' THEN NULL ELSE 'segments' END AS fff_source FROM rq JOIN seg USING (map_type) "
    "LEFT JOIN un USING (run_date, run_hour, map_type))"
)


def resolved(spark, sf):
    available = av.union_hours(views.offered_hours(spark, sf))
    return av.resolve_hours(views.requests(spark, sf), available, map_catalog(spark))


@query(
    "resolve_hours",
    f"WITH {RESOLVED_SQL} SELECT request_id, mode, fff_source, hours IS NOT NULL AS valid, array_to_string(hours, ',') AS hours FROM rs",
)
def _(spark, sf):
    return resolved(spark, sf).select(
        "request_id", "mode", "fff_source", "valid", hour_text("hours").alias("hours")
    )


URL_SQL = (
    "concat('https://nomads.ncep.noaa.gov/cgi-bin/filter_gfs_0p25.pl?file=gfs.t', lpad(CAST(run_hour AS VARCHAR),2,'0'), "
    "'z.pgrb2.0p25.f', lpad(CAST(fff AS VARCHAR),3,'0'), '&', qs, '&leftlon=0&rightlon=360&toplat=90&bottomlat=-90&dir=%2Fgfs.', "
    "strftime(run_date,'%Y%m%d'), '%2F', lpad(CAST(run_hour AS VARCHAR),2,'0'), '%2Fatmos')"
)
FILE_SQL = (
    "concat('gfs.t', lpad(CAST(run_hour AS VARCHAR),2,'0'), 'z.pgrb2.0p25.f', lpad(CAST(fff AS VARCHAR),3,'0'), '.', product, '.grib2')"
)
PLAN_SQL = (
    f"{RESOLVED_SQL}, {CAT_SQL}, pl AS (SELECT request_id, run_date, run_hour, map_type, product, CAST(fff AS INT) AS fff, qs FROM "
    "(SELECT *, unnest(hours) AS fff FROM rs) JOIN cat USING (map_type)), "
    f"plan AS (SELECT *, {FILE_SQL} AS file, {URL_SQL} AS url FROM pl)"
)


def plan(spark, sf):
    return av.fetch_plan(resolved(spark, sf), map_catalog(spark))


@query("fetch_plan", f"WITH {PLAN_SQL} SELECT request_id, product, fff, file, url FROM plan")
def _(spark, sf):
    return plan(spark, sf).select("request_id", "product", "fff", "file", "url")


@query(
    "build_request_url",
    f"WITH {REQUEST_SQL}, {CAT_SQL}, x AS (SELECT *, CAST(request_id%385 AS INT) AS fff FROM rq JOIN cat USING (map_type)) "
    f"SELECT request_id, product, {URL_SQL} AS url, concat('https://nomads.ncep.noaa.gov/pub/data/nccf/com/gfs/prod/gfs.', "
    "strftime(run_date,'%Y%m%d'), '/', lpad(CAST(run_hour AS VARCHAR),2,'0'), '/atmos/gfs.t', lpad(CAST(run_hour AS VARCHAR),2,'0'), "
    "'z.pgrb2.0p25.f', lpad(CAST(fff AS VARCHAR),3,'0'), '.idx') AS idx_url FROM x",
)
def _(spark, sf):
    asked = views.requests(spark, sf).join(F.broadcast(map_catalog(spark)), "map_type")
    at = F.col("run_date"), F.col("run_hour"), (F.col("request_id") % 385).cast("int")
    return asked.select(
        "request_id", "product", text.request_url(*at, F.col("query")).alias("url"), text.index_url(*at).alias("idx_url")
    )


@query(
    "download_plan_size",
    f"WITH {RESOLVED_SQL}, {CAT_SQL}, n AS (SELECT map_type, count(*) AS k FROM cat GROUP BY 1) "
    "SELECT request_id, coalesce(len(hours),0)*k AS n_files FROM rs JOIN n USING (map_type)",
)
def _(spark, sf):
    return av.plan_size(resolved(spark, sf), map_catalog(spark)).select("request_id", "n_files")


PRESENT = (
    "SELECT CAST((p_partkey%4)*6 AS INT) AS run_hour, CAST(p_partkey%50*3 AS INT) AS fff, "
    f"{views.pick([p for _, p, _, _ in PRODUCTS], 'p_size')} AS product, "
    f"{views.pick([m for m, _, _, _ in PRODUCTS], 'p_size')} AS map_type, CAST(p_size-5 AS BIGINT) AS size_bytes FROM part"
)


@query(
    "skip_existing",
    f"WITH {PLAN_SQL}, pr AS ({PRESENT}), ex AS (SELECT DISTINCT map_type, {FILE_SQL} AS file FROM pr WHERE size_bytes>0) "
    "SELECT request_id, file, CASE WHEN ex.file IS NOT NULL THEN 'skipped_existing' ELSE 'to_fetch' END AS status "
    "FROM plan LEFT JOIN ex USING (map_type, file)",
)
def _(spark, sf):
    return av.skip_existing(plan(spark, sf), present(spark, sf)).select("request_id", "file", "status")


def present(spark, sf):
    """Files already there, some of them empty."""
    rows = table(spark, sf, "part").selectExpr(
        "CAST((p_partkey%4)*6 AS INT) AS run_hour", "CAST(p_partkey%50*3 AS INT) AS fff",
        f"{views.pick([p for _, p, _, _ in PRODUCTS], 'p_size')} AS product",
        f"{views.pick([m for m, _, _, _ in PRODUCTS], 'p_size')} AS map_type", "CAST(p_size-5 AS BIGINT) AS size_bytes",
    )
    name = F.concat(text.run_file(F.col("run_hour"), F.col("fff")), F.lit("."), "product", F.lit(".grib2"))
    return rows.select("map_type", name.alias("file"), "size_bytes")


RUN_REQUEST = [
    "o_orderkey AS request_id",
    "CAST(o_orderkey%30-3 AS INT) AS run_hour",
    f"{views.pick(['full', 'f00_only', 'init_only', 'hourly', 'available_only'], 'o_custkey')} AS mode",
    "CAST(o_custkey%50-2 AS INT) AS rpm_limit",
    "CAST(o_orderkey%400-1 AS INT) AS max_fff",
]


@query(
    "validate_run_config",
    f"WITH r AS (SELECT {', '.join(RUN_REQUEST)} FROM orders) SELECT request_id, run_hour BETWEEN 0 AND 23 AND "
    "mode IN ('full','f00_only','init_only') AND rpm_limit>0 AND max_fff>=0 AS valid FROM r",
)
def _(spark, sf):
    return av.valid_requests(table(spark, sf, "orders").selectExpr(*RUN_REQUEST)).select("request_id", "valid")


@query(
    "availability_document",
    f"WITH {LINES_SQL}, {REQ_SQL}, {LOOSE_SQL}, {segments_sql('loose', 'run_hour, map_type, product')}, "
    "s AS (SELECT run_hour, map_type, product, string_agg(concat(start,'-',\"end\",'/',step), ';' ORDER BY start) AS segments FROM segs GROUP BY 1, 2, 3), "
    "a AS (SELECT run_hour, map_type, product, string_agg(fff, ',' ORDER BY fff) AS hours FROM (SELECT DISTINCT * FROM loose) GROUP BY 1, 2, 3), "
    "n AS (SELECT run_hour, count(DISTINCT fff) AS existing FROM idx GROUP BY 1), "
    "p AS (SELECT DISTINCT map_type, product FROM req) SELECT run_hour, map_type, product, CAST(existing AS INT) AS n_existing, "
    "coalesce(hours,'') AS hours, coalesce(segments,'') AS segments FROM n CROSS JOIN p LEFT JOIN a USING (run_hour, map_type, product) "
    "LEFT JOIN s USING (run_hour, map_type, product)",
)
def _(spark, sf):
    return document_rows(availability_documents(spark, sf))


def availability_documents(spark, sf):
    rows, catalog = lines(spark, sf), map_catalog(spark)
    return av.availability_document(av.product_availability(rows, catalog), rows, catalog)


def document_rows(docs):
    """Products of availability documents as rows of plain columns."""
    flat = docs.select("run_hour", "map_type", F.size("fff_existing").alias("n_existing"), F.explode("map_info.products").alias("product", "i"))
    segment = lambda s: F.concat(
        s[0].cast("string"), F.lit("-"), s[1].cast("string"), F.lit("/"), s[2].cast("string")
    )
    return flat.select(
        "run_hour", "map_type", "product", "n_existing", hour_text("i.fff_available").alias("hours"),
        F.array_join(F.transform("i.segments", segment), ";").alias("segments"),
    )


@query(
    "sink_availability_by_map",
    f"WITH {LINES_SQL}, {REQ_SQL}, {LOOSE_SQL}, u AS (SELECT run_hour, map_type, string_agg(fff, ',' ORDER BY fff) AS hours, count(*) AS k FROM "
    "(SELECT DISTINCT run_hour, map_type, fff FROM loose) GROUP BY 1, 2), r AS (SELECT DISTINCT run_hour FROM idx), "
    "m AS (SELECT map_type, CAST(count(DISTINCT product) AS INT) AS n_products FROM req GROUP BY 1) "
    "SELECT run_hour, map_type, n_products, coalesce(hours,'') AS hours, 384 AS max_fff FROM r CROSS JOIN m LEFT JOIN u USING (run_hour, map_type)",
)
def _(spark, sf):
    """Combined documents split by map type, written and read again."""
    docs = availability_documents(spark, sf)
    combined = docs.groupBy("run_date", "run_hour").agg(
        F.first("fff_existing").alias("fff_existing"),
        F.first("fff_existing_segments").alias("fff_existing_segments"),
        F.map_from_entries(F.collect_list(F.struct("map_type", "map_info"))).alias("map_types"),
    )
    split = sinks.availability_by_map(combined.withColumn("max_fff", F.lit(384)))
    path = scratch_dir(spark, "availability")
    sinks.write_json(split, path, ["run_date", "run_hour", "map_type"])
    schema = f"max_fff int, map_info {documents.MAP_INFO}, run_date date, run_hour int, map_type string"
    back = spark.read.schema(schema).json(path)
    return back.select(
        "run_hour", "map_type", F.size("map_info.products").alias("n_products"),
        hour_text("map_info.union_fff").alias("hours"), "max_fff",
    )


AV_DOC = (
    "r AS (SELECT CAST(floor(p_partkey/20) AS BIGINT) AS run_id, p_size FROM part), "
    "m AS (SELECT run_id, string_agg(p_size, ',' ORDER BY p_size) AS own, string_agg(p_size+100, ',' ORDER BY p_size) AS other FROM "
    "(SELECT DISTINCT run_id, p_size FROM r) GROUP BY 1)"
)


@query(
    "scan_availability",
    f"WITH {AV_DOC} SELECT run_id, CAST(CASE WHEN run_id%3=0 OR run_id%5=0 THEN 1 ELSE 0 END AS INT) AS candidate, "
    "CASE WHEN run_id%3=0 OR run_id%5=0 THEN other ELSE own END AS hours FROM m WHERE NOT (run_id%3=0 AND run_id%2=0)",
)
def _(spark, sf):
    """Two candidate documents per run: some empty, some unreadable, hours repeated."""
    rows = table(spark, sf, "part").selectExpr("CAST(floor(p_partkey/20) AS BIGINT) AS run_id", "p_size")
    listed = rows.groupBy("run_id").agg(F.collect_list("p_size").alias("h"))
    json_list = lambda h: F.concat(F.lit("["), F.array_join(F.transform(h, lambda x: x.cast("string")), ","), F.lit("]"))
    own = F.when(F.col("run_id") % 5 == 0, F.lit("{not json")).otherwise(
        F.concat(
            F.lit('{"map_type": "rain_basic", "map_info": {"union_fff": '),
            F.when(F.col("run_id") % 3 == 0, F.lit("[]")).otherwise(json_list(F.col("h"))), F.lit("}}"),
        )
    )
    shifted = F.transform("h", lambda x: x + 100)
    empty = (F.col("run_id") % 3 == 0) & (F.col("run_id") % 2 == 0)
    combined = F.concat(
        F.lit('{"map_types": {"rain_basic": {"union_fff": '),
        F.when(empty, F.lit("[]")).otherwise(json_list(shifted)), F.lit("}}}"),
    )
    both = F.array(
        F.struct(F.lit(0).alias("candidate"), own.alias("json")), F.struct(F.lit(1).alias("candidate"), combined.alias("json"))
    )
    docs = listed.select("run_id", F.explode(both).alias("d")).select("run_id", "d.*")
    parsed = documents.parse_availability(docs).withColumn("hours", documents.listed_hours(F.lit("rain_basic")))
    found = av.first_availability(parsed, ["run_id"])
    return found.select("run_id", "candidate", hour_text("hours").alias("hours"))


# --- files ------------------------------------------------------------------------------


@query(
    "parse_grid_filename",
    f"WITH {FILES_SQL} SELECT file, CAST(nullif(regexp_extract(file,'\\.f(\\d{{3}})\\.(.+)\\.grib2$',1),'') AS INT) AS fff, "
    "nullif(regexp_extract(file,'\\.f(\\d{3})\\.(.+)\\.grib2$',2),'') AS product FROM files",
)
def _(spark, sf):
    name = F.col("file")
    return views.files(spark, sf).select(
        "file", text.grid_file_hour(name).alias("fff"), text.grid_file_product(name).alias("product")
    )


@query(
    "parse_fff",
    f"WITH {FILES_SQL} SELECT file, CAST(nullif(regexp_extract(file,'\\.f(\\d{{3}})\\.',1),'') AS INT) AS fff FROM files",
)
def _(spark, sf):
    return views.files(spark, sf).select("file", text.forecast_hour(F.col("file")).alias("fff"))


ADV_FILE = (
    "CASE c_custkey%5 WHEN 0 THEN concat('ep012026_', lpad(CAST(c_custkey%1000 AS STRING),3,'0'), 'adv_TRACK.kmz') "
    "WHEN 1 THEN concat('ep012026_', lpad(CAST(c_custkey%1000 AS STRING),3,'0'), 'adv_CONE.kmz') "
    "WHEN 2 THEN concat('ep012026_5day_', lpad(CAST(c_custkey%1000 AS STRING),3,'0'), '.zip') WHEN 3 THEN 'readme.txt' "
    "ELSE concat('EP012026_', lpad(CAST(c_custkey%1000 AS STRING),3,'0'), 'ADV_x.kmz') END AS file"
)


@query(
    "list_advisory_files",
    "SELECT c_custkey, CASE c_custkey%5 WHEN 0 THEN 'track' WHEN 1 THEN 'cone' WHEN 2 THEN 'five_day' ELSE 'other' END AS kind, "
    "CAST(CASE c_custkey%5 WHEN 3 THEN -1 ELSE c_custkey%1000 END AS INT) AS adv FROM customer",
)
def _(spark, sf):
    names = table(spark, sf, "customer").selectExpr("c_custkey", ADV_FILE)
    return listings.advisory_files(names).select("c_custkey", "kind", "adv")


SUMMARY_SQL = (
    f"{FILES_SQL}, g AS (SELECT *, CAST(nullif(regexp_extract(file,'\\.f(\\d{{3}})\\.',1),'') AS INT) AS fff FROM files WHERE file LIKE '%.grib2'), "
    "sm AS (SELECT map_type, count(*) AS file_count, round_even(sum(size_bytes)/1048576e0,3) AS total_size_mb, "
    "array_to_string(list_sort(list_distinct(list(fff) FILTER (fff IS NOT NULL))),',') AS fff_available FROM g GROUP BY 1)"
)


@query("file_summary", f"WITH {SUMMARY_SQL} SELECT * FROM sm")
def _(spark, sf):
    out = files.file_summary(views.files(spark, sf))
    return out.withColumn("fff_available", hour_text("fff_available"))


@query("file_sizes_mb", f"WITH {SUMMARY_SQL} SELECT map_type, file, round_even(size_bytes/1048576e0,3) AS size_mb FROM g")
def _(spark, sf):
    return files.file_entries(views.files(spark, sf)).select("map_type", "file", "size_mb")


@query(
    "run_summary",
    f"WITH {SUMMARY_SQL} SELECT map_type, count(*) AS requested, count(*) FILTER (status='downloaded') AS downloaded, "
    "any_value(file_count) AS files_present, any_value(total_size_mb) AS total_size_mb FROM files JOIN sm USING (map_type) GROUP BY 1",
)
def _(spark, sf):
    rows = views.files(spark, sf)
    return files.run_summary(rows.select("map_type", "status"), rows)


@query(
    "file_status_filter",
    f"WITH {FILES_SQL} SELECT map_type, count(*) AS downloaded FROM files WHERE status='downloaded' GROUP BY 1",
)
def _(spark, sf):
    done = views.files(spark, sf).filter("status = 'downloaded'")
    return done.groupBy("map_type").agg(F.count(F.lit(1)).alias("downloaded"))


@query(
    "sink_file_summary",
    f"WITH {SUMMARY_SQL} SELECT map_type, file, size_bytes, fff, file_count, total_size_mb FROM g JOIN sm USING (map_type)",
)
def _(spark, sf):
    """Summary documents with file lists, written by map type and read again."""
    rows = views.files(spark, sf)
    docs = sinks.summary_documents(files.file_entries(rows), files.file_summary(rows), 1000)
    path = scratch_dir(spark, "summary")
    sinks.write_json(docs, path, ["map_type"])
    schema = (
        "part int, files array<struct<file:string,size_bytes:bigint,fff:int>>, file_count bigint, "
        "total_size_mb double, fff_available array<int>, map_type string"
    )
    return spark.read.schema(schema).json(path).select(
        "map_type", F.explode("files").alias("f"), "file_count", "total_size_mb"
    ).select("map_type", "f.file", "f.size_bytes", "f.fff", "file_count", "total_size_mb")


@query(
    "sink_manifest",
    f"WITH {PLAN_SQL}, pr AS ({PRESENT}), ex AS (SELECT DISTINCT map_type, {FILE_SQL} AS file FROM pr WHERE size_bytes>0), "
    "dl AS (SELECT request_id, count(*) AS n_files, count(ex.file) AS n_skipped FROM plan LEFT JOIN ex USING (map_type, file) GROUP BY 1) "
    "SELECT rq.request_id, rq.mode, coalesce(len(rs.hours),0) AS n_hours, coalesce(n_files,0) AS n_files, "
    "coalesce(n_skipped,0) AS n_skipped FROM rq JOIN rs USING (request_id) LEFT JOIN dl USING (request_id)",
)
def _(spark, sf):
    """Manifests of all requests, written and read again."""
    asked = resolved(spark, sf)
    checked = av.skip_existing(plan(spark, sf), present(spark, sf))
    docs = sinks.manifest_documents(checked, asked.drop("valid"), ["request_id"])
    path = scratch_dir(spark, "manifest")
    sinks.write_json(docs, path)
    schema = (
        "request_id bigint, mode string, hours array<int>, "
        "downloads array<struct<fff:int,product:string,file:string,status:string,url:string>>"
    )
    back = spark.read.schema(schema).json(path)
    return back.select(
        "request_id", "mode",
        F.coalesce(F.size("hours"), F.lit(0)).cast("long").alias("n_hours"),
        F.size("downloads").cast("long").alias("n_files"),
        F.size(F.filter("downloads", lambda d: d["status"] == "skipped_existing")).cast("long").alias("n_skipped"),
    )


# --- feeds ------------------------------------------------------------------------------

SCORE_SQL = (
    "(CASE WHEN b LIKE '%VPTW%' THEN 4 ELSE 0 END+CASE WHEN b LIKE '%VPWW54%' THEN 3 ELSE 0 END+CASE WHEN b LIKE '%VPWW53%' THEN 2 ELSE 0 END"
    "+CASE WHEN lower(b) LIKE '%.xml' THEN 1 ELSE 0 END)"
)
FEED_SQL = f"{ENTRIES_SQL}, bl AS (SELECT *, concat(id,' ',link) AS b FROM entries), sc AS (SELECT *, {SCORE_SQL} AS score FROM bl)"
CODED = "(b LIKE '%VPTW%' OR b LIKE '%VPWW53%' OR b LIKE '%VPWW54%')"


@query("feed_score", f"WITH {FEED_SQL} SELECT page_id, score FROM sc")
def _(spark, sf):
    return views.entries(spark, sf).select(
        "page_id", classify.feed_score(F.col("id"), F.col("link")).alias("score")
    )


@query("feed_code_filter", f"WITH {FEED_SQL} SELECT page_id, id, title FROM sc WHERE {CODED} AND title LIKE '%Typhoon Information%'")
def _(spark, sf):
    return feeds.bulletin_entries(views.entries(spark, sf), "Typhoon Information").select("page_id", "id", "title")


@query("rank_feed_entries", f"WITH {FEED_SQL} SELECT id, score, updated FROM sc WHERE {CODED} ORDER BY score DESC, updated DESC, id")
def _(spark, sf):
    return feeds.ranked_entries(views.entries(spark, sf)).select("id", "score", "updated")


@query(
    "first_parsable_bulletin",
    f"WITH {FEED_SQL}, {BULLETIN_SQL}, n AS (SELECT bulletin, count(*) AS n_points FROM bp GROUP BY 1) "
    f"SELECT id, score, n_points FROM sc JOIN n ON sc.page_id=n.bulletin WHERE {CODED} AND page_id%5<>3 ORDER BY score DESC, updated DESC, id LIMIT 1",
)
def _(spark, sf):
    """Each feed entry points to a bulletin; some bulletins have no readable point."""
    entries = views.entries(spark, sf)
    empty = F.lit("<Report><Head/><Body/></Report>")
    docs = views.bulletins(spark, sf).withColumnRenamed("bulletin", "page_id").withColumn(
        "xml", F.when(F.col("page_id") % 5 == 3, empty).otherwise(F.col("xml"))
    )
    points = markup.parse_bulletins(docs).join(entries.select("page_id", "id"), "page_id")
    return feeds.first_readable(entries, points).select("id", "score", "n_points")


REGION_IDS = [*markup.REGIONS, "OTHER"]


@query(
    "region_dim_join",
    f"WITH p AS (SELECT page_id, {views.pick(REGION_IDS, 'page_id')} AS guid FROM pages) SELECT page_id, CASE guid "
    + " ".join(f"WHEN '{g}' THEN '{n}'" for g, n in markup.REGIONS.items())
    + " END AS region FROM p WHERE guid<>'OTHER'",
)
def _(spark, sf):
    """Items with the name of their region (four regions, so the table is broadcast)."""
    items = table(spark, sf, "pages").selectExpr("page_id", f"{views.pick(REGION_IDS, 'page_id')} AS guid")
    return items.join(F.broadcast(markup.region_table(spark)), "guid").select("page_id", "region")

