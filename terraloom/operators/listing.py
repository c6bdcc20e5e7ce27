"""Operators on listings: poles, scenes, files, features and sets of sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col

#: Words that tell a pole's owner, and names of sensors that see heat.
CITY = "city|municipal|dedicated|standard|mast arm|concrete|steel|aluminum|decorative|pedestrian|park|owned".split("|")
SHARED = "wood|wooden|utility|national grid|power pole|joint|shared|co-located|collocated".split("|")
HEAT = "lwir thermal flir lepton".split()
LOCATION_FIELDS = "location point geo_point the_geom geom".split()


def has_any(text: Column, words: Sequence[str]) -> Column:
    low = F.lower(text)
    found = F.lit(False)
    for w in words:
        found = found | low.contains(w.lower())
    return found


def is_city_owned(fields: Sequence[Column]) -> Column:
    """Ownership by the first field that decides: words of shared poles beat those of
    the city's within a field; a row that no field decides is kept."""
    told = [F.when(x.isNull() | (x == ""), None).when(has_any(x, SHARED), False).when(has_any(x, CITY), True) for x in fields]
    return F.coalesce(*told, F.lit(True))


def parse_box(text: Column) -> Column:
    """lat_min, lat_max, lon_min, lon_max of "a,b,c,d"; null if it isn't four numbers."""
    parts = F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("double"))
    ok = (F.size(parts) == 4) & (F.size(F.array_compact(parts)) == 4)
    return F.when(ok, F.struct(*(F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(("lat_min", "lat_max", "lon_min", "lon_max")))))


def box_predicate(text: Column, column: str = LOCATION_FIELDS[0]) -> Column:
    """The server's filter on a box, by the first name that a location goes by."""
    b = parse_box(text)
    number = lambda f: b[f].cast("string")
    return F.when(b.isNotNull(), F.concat(F.lit(f"within_box({column}, "), F.concat_ws(", ", number("lat_max"), number("lon_min"), number("lat_min"), number("lon_max")), F.lit(")")))


def in_box(lat: Column, lon: Column, lat_min, lat_max, lon_min, lon_max) -> Column:
    """Whether a position is in a box, its edges included; an open bound holds all."""
    within = lambda x, lo, hi: F.coalesce(x >= lo, F.lit(True)) & F.coalesce(x <= hi, F.lit(True))
    return within(lat, lat_min, lat_max) & within(lon, lon_min, lon_max)


def first_of_each(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Each key's first row in order."""
    first = df.groupBy(key).agg(F.min(F.struct(*order, F.struct(*df.columns).alias("row"))).alias("m"))
    return first.select("m.row.*")


def probe_position(row: Column) -> Column:
    """lon, lat of a map of strings: latitude or lat, longitude, lon or lng; y and x last."""
    pick = lambda *names: F.coalesce(*(F.nullif(row[n], F.lit("")) for n in names))
    lat, lon = pick("latitude", "lat", "y").try_cast("double"), pick("longitude", "lon", "lng", "x").try_cast("double")
    return F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lon.alias("lon"), lat.alias("lat")))


def feature(lon: Column, lat: Column, properties: Column) -> Column:
    """A GeoJSON point feature as text; without a position its geometry is null."""
    point = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    geometry = F.when(lon.isNotNull() & lat.isNotNull(), point)
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")), {"ignoreNullFields": "false"})


def scenes_between(scenes: DataFrame, start: Column, end: Column, most_cloud: float = 0.20, limit: int | None = None) -> DataFrame:
    """Scenes (acquired, cloud_cover) of a span of time that are clear enough."""
    found = scenes.where(c("acquired").between(start, end) & (c("cloud_cover") <= most_cloud))
    return found if limit is None else found.orderBy("acquired", "id").limit(limit)


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def file_suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/.](\.[^./]*)$", 1))


def is_heat_image(path: Column, words: Sequence[str] = HEAT) -> Column:
    return has_any(file_stem(path), words)


def visible_images(files: DataFrame, path: str = "path", suffixes: Sequence[str] = (".jpg", ".jpeg", ".png")) -> DataFrame:
    """Images that aren't in a hidden folder and don't show heat, each once."""
    hidden = c(path).rlike(r"(^|/)\.[^/]")
    return files.where(file_suffix(c(path)).isin(*suffixes) & ~hidden & ~is_heat_image(c(path))).dropDuplicates([path])


def unique_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """Adds ``unique``: the name, with _1, _2 ... before its suffix from its second row on."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1
    stem, suffix = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    return df.withColumn("unique", F.when(n == 0, c(name)).otherwise(F.concat(stem, F.lit("_"), n.cast("string"), suffix)))


def folder_counts(files: DataFrame, path: str = "path") -> DataFrame:
    """For each top folder, how many files lie in it and how many deeper."""
    parts = F.split(c(path), "/")
    df = files.select(parts[0].alias("folder"), F.size(parts).alias("depth")).where("depth > 1")
    return df.groupBy("folder").agg(F.count_if(c("depth") == 2).alias("here"), F.count_if(c("depth") > 2).alias("deeper"))


def top_by(df: DataFrame, value: str, order: str, k: int, least: float | None = None) -> DataFrame:
    """The k rows of greatest value among those of at least ``least``."""
    kept = df if least is None else df.where(c(value) >= least)
    return kept.orderBy(F.desc(value), order).limit(k)


def seeded_subset(df: DataFrame, id_col: str, k: int, seed: int) -> DataFrame:
    """k rows chosen by a hash of their id: the same at every run and partitioning."""
    return df.orderBy(F.xxhash64(id_col, F.lit(seed)), id_col).limit(k)


def modes(df: DataFrame, by: str, mode: str) -> DataFrame:
    """Each group's distinct modes in order, joined by plus signs."""
    return df.groupBy(by).agg(F.array_join(F.array_sort(F.collect_set(mode)), "+").alias("modes"))


def fields_present(df: DataFrame, row: str, names: Sequence[str]) -> DataFrame:
    """Which of the names any row's map has."""
    return df.agg(*(F.coalesce(F.bool_or(F.map_contains_key(row, n)), F.lit(False)).alias(n) for n in names))


def appended(old: DataFrame, new: DataFrame, id_col: str) -> DataFrame:
    """The old points and the new ones, whose ids (from 0) go on after the old ones'."""
    last = old.agg((F.coalesce(F.max(id_col), F.lit(-1)) + 1).alias("_next"))
    return old.unionByName(new.join(F.broadcast(last)).withColumn(id_col, c(id_col) + c("_next")).drop("_next"))
