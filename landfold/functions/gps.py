"""GPS tags of photos and movies as column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# File name endings, compass points.
IMAGES = r"\.(jpg|jpeg|heic|png|tif|tiff)$"
MOVIES = r"\.(mov|mp4)$"
POINTS = ["N", "NE", "E", "SE", "S", "SW", "W", "NW"]


def dms_to_decimal(part: str, negative: str) -> Column:
    """Degrees from columns {part}_deg_num, _deg_den, _min_..., _sec_... and {part}_ref; null if one is missing or a zero."""
    ratio = lambda u: F.when(F.col(f"{part}_{u}_den") != 0, F.col(f"{part}_{u}_num") / F.col(f"{part}_{u}_den"))
    value = ratio("deg") + ratio("min") / 60 + ratio("sec") / 3600
    return F.when(F.col(f"{part}_ref") == negative, -value).otherwise(value)


def gps_altitude() -> Column:
    """Metres from alt_num, alt_den, alt_ref; below sea level negative; null for a zero denominator."""
    value = F.when(F.col("alt_den") != 0, F.col("alt_num") / F.col("alt_den"))
    return F.when(F.col("alt_ref").isin("1", "Below sea level"), -value).otherwise(value)


def photo_datetime() -> Column:
    return F.coalesce("dt_original", "dt_image")


def photo_timestamp() -> Column:
    return F.try_to_timestamp(photo_datetime(), F.lit("yyyy:MM:dd HH:mm:ss"))


def parse_iso6709(text: Column) -> dict[str, Column]:
    """lat, lon, alt (null if absent) and taken_at of a movie's text; nulls where nothing is found."""
    place = r"([+-]\d{2,3}\.\d+)([+-]\d{2,3}\.\d+)(?:([+-]\d+\.\d+))?/"
    part = lambda k: F.nullif(F.regexp_extract(text, place, k), F.lit("")).cast("double")
    when = r"(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2}:\d{2})"
    day, time = F.regexp_extract(text, when, 1), F.regexp_extract(text, when, 2)
    taken = F.when(day != "", F.concat_ws(" ", F.translate(day, "-", ":"), time)).otherwise("")
    return {"lat": part(1), "lon": part(2), "alt": part(3), "taken_at": taken}


def compass8(direction: Column) -> Column:
    """One of eight points for a bearing in degrees; null stays null."""
    at = F.pmod(F.floor(direction / 45 + 0.5), F.lit(8)).cast("int")
    return F.element_at(F.array(*map(F.lit, POINTS)), at + 1)


def photo_paths(name: Column, folder: str) -> dict[str, Column]:
    base = F.regexp_replace(name, r"\.[^.]+$", "")
    return {"thumb": F.concat(F.lit(f"{folder}/thumbs/"), base, F.lit(".jpg")), "mid": F.concat(F.lit(f"{folder}/mid/"), base, F.lit(".jpg")), "full": F.concat(F.lit(f"{folder}/"), name)}


def tag_counts(photos: DataFrame, tags: DataFrame) -> DataFrame:
    """(tag, label, color, n) of the tags that photos use."""
    return photos.where("tag is not null").join(tags, "tag").groupBy("tag", "label", "color").agg(F.count(F.lit(1)).alias("n"))


def gps_listing(files: DataFrame) -> DataFrame:
    """(name, lat, lon, alt, taken_at, status) of files(name, readable, tag columns, text); other endings are left out.

    The tag columns are those of ``dms_to_decimal`` (lat_, lon_), ``gps_altitude`` and ``photo_datetime``; text is a
    movie's container text.
    """
    low = F.lower("name")
    lat, lon = dms_to_decimal("lat", "S"), dms_to_decimal("lon", "W")
    found = lat.isNotNull() & lon.isNotNull()
    images = files.where(low.rlike(IMAGES)).select(
        "name",
        F.when(F.col("readable") & found, lat).alias("lat"),
        F.when(F.col("readable") & found, lon).alias("lon"),
        F.when(F.col("readable") & found, gps_altitude()).alias("alt"),
        F.when(F.col("readable"), F.coalesce(photo_datetime(), F.lit(""))).otherwise("").alias("taken_at"),
        F.when(~F.col("readable"), "read error").when(found, "OK").otherwise("no GPS").alias("status"),
    )
    m = parse_iso6709(F.coalesce("text", F.lit("")))
    placed = m["lat"].isNotNull()
    movies = files.where(low.rlike(MOVIES)).select(
        "name", m["lat"].alias("lat"), m["lon"].alias("lon"), m["alt"].alias("alt"), F.when(placed, m["taken_at"]).otherwise("").alias("taken_at"), F.when(placed, "OK (movie)").otherwise("no GPS (movie)").alias("status")
    )
    return images.unionByName(movies)
