"""What users type and how files are called: series, movies, videos, releases, modes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import title_case


def _cased(name: Column, unknown: str) -> Column:
    """Collapsed white space; title case where no letter but the first is upper case."""
    one = F.trim(F.regexp_replace(name, r"\s+", " "))
    plain = (F.length(one) > 1) & ~F.substr(one, F.lit(2)).rlike(r"\p{Lu}")
    return F.when(one == "", unknown).when(plain, title_case(one)).otherwise(one)


def series_input(typed: Column) -> Column:
    """struct(series, season, episode) of a user's message; season and episode default to 1."""
    t = F.trim(F.coalesce(typed, F.lit("")))
    name, season, episode = t, F.lit(1), F.lit(1)
    for pattern, season_first in reversed(fixed.TYPED_EPISODES):
        found = t.rlike(pattern)
        numbers = [F.regexp_extract(t, pattern, i).try_cast("int") for i in (1, 2)]
        s, e = numbers if season_first else numbers[::-1]
        name = F.when(found, F.btrim(F.regexp_replace(t, pattern, ""), F.lit(" .,;"))).otherwise(name)
        season, episode = F.when(found, s).otherwise(season), F.when(found, e).otherwise(episode)
    return F.struct(_cased(name, "Unknown").alias("series"), season.alias("season"), episode.alias("episode"))


def movie_input(typed: Column) -> Column:
    """struct(movie, year) of a user's message; year 0 if none stands at the end."""
    t = F.trim(F.coalesce(typed, F.lit("")))
    year = F.coalesce(F.regexp_extract(t, fixed.TYPED_YEAR, 1).try_cast("int"), F.lit(0))
    name = F.when(year > 0, F.btrim(F.regexp_replace(t, fixed.TYPED_YEAR, ""), F.lit(" .,;()"))).otherwise(t)
    return F.struct(_cased(name, "Unknown").alias("movie"), year.alias("year"))


def _parts(path: Column) -> tuple[Column, Column]:
    """The folders and file of a path, and the file's name without its last suffix."""
    parts = F.split(path, "/")
    return parts, F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]*$", "")


def _after(parts: Column, folder: str) -> Column:
    """The part that follows ``folder``, if any."""
    at = F.array_position(parts, folder).cast("int")
    return F.when((at > 0) & (at < F.size(parts)), F.get(parts, at))


def _spaced(name: Column) -> Column:
    return title_case(F.trim(F.translate(name, "_.", "  ")))


def movie_info(path: Column) -> Column:
    """struct(series, year) of a movie's subtitle path: the folder below ``Movies``, else the file's name."""
    parts, stem = _parts(path)
    folder = _after(parts, "Movies")
    named = F.regexp_extract(stem, r"^(.+?)_((?:19|20)\d{2})$", 1)
    in_folder, in_name = F.regexp_extract(stem, r"_?((?:19|20)\d{2})$", 1), F.regexp_extract(stem, r"^.+?_((?:19|20)\d{2})$", 1)
    year = F.nullif(F.when(folder.isNotNull(), in_folder).otherwise(in_name), F.lit(""))
    name = F.coalesce(folder, F.when(named != "", _spaced(named)).otherwise(_spaced(stem)))
    return F.struct(F.when(name == "", "Unknown").otherwise(name).alias("series"), year.alias("year"))


def video_info(path: Column) -> Column:
    """struct(series, youtube_id) of a video's subtitle path: the folder below ``YouTube``, else the file's name."""
    parts, stem = _parts(path)
    tail = r"_([A-Za-z0-9_-]{6,})$"
    name = F.coalesce(_after(parts, "YouTube"), _spaced(F.regexp_replace(stem, tail, "")))
    return F.struct(F.when(name == "", "YouTube Video").otherwise(name).alias("series"), F.nullif(F.regexp_extract(stem, tail, 1), F.lit("")).alias("youtube_id"))


def release_info(filename: Column) -> Column:
    """struct(series, season, episode) of a release's file name; name and series are bound to variables, so that each step runs once."""
    return F.transform(F.array(_parts(filename)[1]), _release)[0]


def _release(stem: Column) -> Column:
    tags = [r"[Ss](\d+)[Ee](\d+)", r"(?i)season\s*(\d+).*?episode\s*(\d+)"]
    number = lambda i: F.coalesce(*(F.regexp_extract(stem, tag, i).try_cast("int") for tag in tags))
    name = stem
    for pattern, by, any_case in fixed.RELEASE_NOISE:
        name = F.regexp_replace(name, ("(?i)" if any_case else "") + pattern, by)
    name = F.btrim(F.regexp_replace(F.regexp_replace(name, r"\.+", "."), r"\s+", " "), F.lit(" .-_"))
    words = F.filter(F.split(F.translate(name, "._", "  "), " +"), lambda x: x != "")
    name = F.array_join(F.transform(words, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substr(x, F.lit(2))))), " ")
    low = F.lower(stem)
    known = F.array(*(F.lit(x) for x in reversed(fixed.KNOWN_SERIES)))
    name = F.aggregate(known, name, lambda own, x: F.when(own.contains(x) | low.contains(F.replace(F.lower(x), F.lit(" "), F.lit("."))), x).otherwise(own))
    return F.struct(F.nullif(name, F.lit("")).alias("series"), number(1).alias("season"), number(2).alias("episode"))


def folder_slug(path: Column, root: str) -> Column:
    """A name for an artefact made of its folder below ``root``."""
    below = F.when(path.startswith(root + "/"), F.substr(path, F.lit(len(root) + 2))).otherwise(path)
    s = F.translate(F.replace(below, F.lit("/"), F.lit("__")), " ", "_")
    s = F.btrim(F.regexp_replace(s, r"[^a-zA-Z0-9_.-]+", "_"), F.lit("_"))
    return F.when(s == "", "episode").otherwise(s)


def translation_mode(value: Column) -> Column:
    raw = F.translate(F.lower(F.trim(F.coalesce(value, F.lit("")))), "-", "_")
    return F.when(raw.isin(*fixed.MODES["russian"]), "russian").otherwise("english_dictionary")


def error_kind(message: Column) -> Column:
    """quota, rate_limit, authentication or other."""
    low, out = F.lower(message), F.lit("other")
    for kind, words in reversed(fixed.ERROR_KINDS.items()):
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, kind).otherwise(out)
    return out


def release_year(date: Column) -> Column:
    """The year of ``YYYY-MM-DD``, 0 where there is none."""
    return F.coalesce(F.substring(date, 1, 4).try_cast("int"), F.lit(0))


def parsed_time(value: Column) -> Column:
    """An ISO time, null where it is none."""
    return F.try_to_timestamp(F.nullif(F.trim(value), F.lit("")))
