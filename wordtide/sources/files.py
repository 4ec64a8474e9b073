"""Readers. A missing word column is the first column; paths may be globs or folders."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..operators import tiers
from . import formats

TIER_SCHEMA = "word string, series_frequency long, english_frequency long, vocabulary_level string"


def subtitles(spark: SparkSession, path: str) -> DataFrame:
    """path, content of every .srt file; bytes that are no UTF-8 are dropped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.srt").load(path)

    @F.pandas_udf(T.StringType())
    def decoded(body: pd.Series) -> pd.Series:
        return body.map(lambda x: bytes(x).decode("utf-8", "ignore"))

    return files.select("path", decoded("content").alias("content"))


def zipped_subtitles(spark: SparkSession, path: str) -> DataFrame:
    """path, content of the first member ending in .srt of every .zip; an archive without one is an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(path)

    @F.pandas_udf(T.StringType())
    def first_member(body: pd.Series) -> pd.Series:
        def read(x):
            with zipfile.ZipFile(io.BytesIO(bytes(x))) as z:
                names = [n for n in z.namelist() if n.endswith(".srt")]
                if not names:
                    raise ValueError("no .srt file in the archive")
                return z.read(names[0]).decode("utf-8", "ignore")

        return body.map(read)

    return files.select("path", first_member("content").alias("content"))


def word_lists(spark: SparkSession, path: str, without_oxford: bool = False) -> DataFrame:
    """word, filter_class (oxford, easy or basic, by file name): raw words and their singular forms."""
    rows = spark.read.option("header", True).csv(path)
    name = F.lower(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1))
    kind = F.when(name.contains("oxford"), "oxford").when(name.contains("easy"), "easy").otherwise("basic")
    raw = rows.select(F.lower(F.trim(rows.columns[0])).alias("word"), kind.alias("filter_class")).where("word != ''")
    out = raw.unionByName(raw.withColumn("word", text.singular(F.col("word")))).distinct()
    return out.where("filter_class != 'oxford'") if without_oxford else out


def english_frequencies(spark: SparkSession, path: str) -> DataFrame:
    """word, english_frequency of a ``word,count`` file: a word's last row counts; singular forms are summed, and a
    raw word that is no singular form of any keeps its own."""
    rows = spark.read.schema("word string, n long").option("header", True).csv(path).withColumn("at", F.monotonically_increasing_id())
    last = F.max_by("n", "at")
    raw = rows.where("word IS NOT NULL AND n IS NOT NULL").groupBy(F.lower(F.trim("word")).alias("word")).agg(last.alias("n"))
    lemmas = raw.groupBy(text.singular(F.col("word")).alias("word")).agg(F.sum("n").alias("english_frequency"))
    return lemmas.unionByName(raw.join(lemmas, "word", "left_anti").select("word", F.col("n").alias("english_frequency")))


def levels(spark: SparkSession, path: str, highest: bool = False) -> DataFrame:
    """word, level of a word list (csv, or the first sheet of workbooks below their first rows): the lowest or highest of several."""
    if path.endswith(".xlsx"):
        formats.register(spark)
        cells = spark.read.format("workbook").option("first", "true").load(path)
        broken = cells.where("error IS NOT NULL").select("path", "error").first()
        if broken:
            raise ValueError(f"{broken['path']}: {broken['error']}")
        rows = cells.where("row > 1 AND cells[0] IS NOT NULL").select(F.get("cells", F.lit(0)).alias("word"), F.trim(F.get("cells", F.lit(1))).alias("level"))
    else:
        rows = spark.read.schema("word string, level string").option("header", True).csv(path)
    return tiers.one_level(rows.select(F.lower(F.trim("word")).alias("word"), "level"), highest)


def tier_table(spark: SparkSession, path: str) -> DataFrame:
    """A tier table as written by ``sinks.write_tiers``; rows without a word go."""
    return spark.read.schema(f"{TIER_SCHEMA}, filter_reason string").option("header", True).csv(path).where("trim(word) != ''")


def first_seen(tables: list[DataFrame]) -> DataFrame:
    """Tables one after the other, a word of any case only once: the first."""
    rows = None
    for i, t in enumerate(tables):
        t = t.withColumn("at", F.struct(F.lit(i).alias("table"), F.monotonically_increasing_id().alias("row")))
        rows = t if rows is None else rows.unionByName(t, allowMissingColumns=True)
    order = W.partitionBy(F.lower("word")).orderBy("at")
    return rows.withColumn("place", F.row_number().over(order)).where("place = 1").drop("at", "place")


def glosses(spark: SparkSession, path: str, band: str | None = None) -> DataFrame:
    """word, gloss (and band) of translation tables; empty and failed ones go."""
    rows = spark.read.option("header", True).csv(path)
    gloss = next((c for c in rows.columns if c.startswith("translation")), rows.columns[1])
    bad = F.lower(F.trim(gloss)).isin("", "—", "n/a", "na", "[translation failed]")
    out = rows.select(F.col(rows.columns[0]).alias("word"), F.trim(gloss).alias("gloss")).where(F.col("gloss").isNotNull() & ~bad)
    return out.withColumn("band", F.lit(band)) if band else out


def phrases(spark: SparkSession, path: str) -> DataFrame:
    """phrase, n, gloss, score of phrasal or idiom tables, older column names too."""
    rows = spark.read.option("header", True).csv(path)

    def either(*names):
        found = [F.nullif(F.trim(c), F.lit("")) for c in names if c in rows.columns]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    return rows.select(
        either("phrasal_verb", "expression").alias("phrase"),
        either("frequency").try_cast("long").alias("n"),
        either("translation").alias("gloss"),
        text.whole_score(either("idiomacy_rating", "idiomaticity_score")).alias("score"),
    ).where("phrase IS NOT NULL")


def state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON state or sidecar files; a broken one gives nulls."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def vtt_blocks(contents: DataFrame) -> DataFrame:
    """path, at, block of WebVTT ``content``: what a cue's lines stand in."""
    lines = F.regexp_replace(F.regexp_replace("content", "\ufeff", ""), r"\r\n?", "\n")
    return contents.select("path", F.posexplode(F.split(lines, r"\n[ \t]*\n|\n(?=[^\n]*-->)")).alias("at", "block"))


def numbered_cues(blocks: DataFrame) -> DataFrame:
    """path, number, start, end, body: the cues of ``blocks`` (path, at, block), times as SRT has them, renumbered per file."""
    timing = r"(?m)^\s*(\S+)\s*-->\s*(\S+).*$"
    body = F.filter(F.transform(F.split(F.regexp_extract("block", r"(?s)-->[^\n]*\n(.*)", 1), "\n"), lambda x: F.trim(text.stripped_markup(x))), lambda x: (x != "") & ~x.rlike("^(NOTE|STYLE|REGION|Kind:|Language:)"))
    cues = blocks.where(F.col("block").contains("-->")).select("path", "at", text.srt_timestamp(F.regexp_extract("block", timing, 1)).alias("start"), text.srt_timestamp(F.regexp_extract("block", timing, 2)).alias("end"), F.array_join(body, "\n").alias("body"))
    number = F.row_number().over(W.partitionBy("path").orderBy("at"))
    return cues.where("body != ''").withColumn("number", number).select("path", "number", "start", "end", "body")


def vtt_cues(contents: DataFrame) -> DataFrame:
    """The numbered cues of WebVTT files (path, content)."""
    return numbered_cues(vtt_blocks(contents))


def chosen_caption(tracks: DataFrame) -> DataFrame:
    """Of (video, language, automatic, preferred) tracks one for each video: manual preferred, automatic preferred, any manual, any."""
    rank = F.when(F.col("preferred") & ~F.col("automatic"), 0).when(F.col("preferred"), 1).when(~F.col("automatic"), 2).otherwise(3)
    return tracks.groupBy("video").agg(F.min_by(F.struct("language", "automatic"), F.struct(rank, F.col("language"))).alias("track")).select("video", "track.*")


def changed_files(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Files under ``path`` whose size or time of change is not in ``manifest`` (path, size, mtime): those to analyse again."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    seen = files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    return seen.join(manifest, ["path", "size", "mtime"], "left_anti")


def file_listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, size, mtime of all files below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def _name(path):
    return F.regexp_extract(path, r"([^/]*)$", 1)


def discovered(listing: DataFrame, wanted: DataFrame) -> DataFrame:
    """file, season, episode, path: of the files called ``file`` the first by path, one whose name tags the episode before all others."""
    token = F.concat(F.lit("_s"), "season", F.lit("_e"), "episode")
    met = wanted.where("file != '' AND file != 'unknown.srt'").join(listing.select(_name(F.col("path")).alias("file"), "path"), "file")
    tagged = F.lower("file").contains(token)
    return met.groupBy("file", "season", "episode").agg(F.min_by("path", F.struct(~F.coalesce(tagged, F.lit(False)), F.col("path"))).alias("path"))


def episode_folders(infos: DataFrame, wanted: DataFrame) -> DataFrame:
    """file, folder: where an ``episode_info`` (folder, subtitle_file) names the subtitle; the exact path wins over the bare name."""
    exact = infos.groupBy(F.col("subtitle_file").alias("file")).agg(F.min("folder").alias("exact"))
    bare = infos.groupBy(_name(F.col("subtitle_file")).alias("name")).agg(F.min("folder").alias("bare"))
    out = wanted.join(exact, "file", "left").withColumn("name", _name(F.col("file"))).join(bare, "name", "left")
    return out.select("file", F.coalesce("exact", "bare").alias("folder"))


def existing_artefacts(listing: DataFrame, folders: DataFrame) -> DataFrame:
    """folder, has_tiers, has_rare, has_glosses, has_subtitle: which artefacts of an episode's folder are there."""
    held = listing.select(F.regexp_replace("path", r"/[^/]*$", "").alias("folder"), _name(F.col("path")).alias("name"))
    is_ = lambda *names: F.count_if(F.col("name").isin(*names))
    found = held.groupBy("folder").agg(
        (is_("tier_1_hard_usable_words.csv") > 0).alias("has_tiers"),
        ((is_("tier_4_rare_b_words.csv") > 0) & (is_("tier_4_rare_c_words.csv") > 0)).alias("has_rare"),
        (F.count_if(F.col("name").endswith("_translations.csv")) > 0).alias("has_glosses"),
        (F.count_if(F.col("name").endswith(".srt")) > 0).alias("has_subtitle"),
    )
    return folders.join(found, "folder", "left").fillna(False)
