"""Further queries of the catalogue: typed titles and file names, tags, shown lists, judges, plans and reports.

Inputs that the driver's tables lack (what users type, file names, model answers, artefacts) are made from
their rows by plain rules; the SQL states the expected result of the rule, not the parsing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed, names, text
from ..functions.scratch import stored
from ..operators import activity, frequency, phrases, reports, tags, tiers
from .catalogue import S_CANDIDATES, S_ENGLISH, S_EVENTS, S_LEVEL, S_LISTS, S_TOK, S_TOP, counted, level_of, list_words, listed, ngram_topk, ngrams_filtered, query, table

LEAST_SIMPLE = 50


def parts(spark, sf_dir, kinds: int) -> DataFrame:
    """p_partkey, p_name, p_type, k (0 to kinds - 1), season, episode."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", (key % kinds).alias("k"), (F.col("p_size") % 9 + 1).alias("season"), (key % 20 + 1).alias("episode"))


def by_kind(*values):
    """The value of the row's ``k``."""
    out = F.lit(None).cast("string")
    for i, v in enumerate(values):
        out = F.when(F.col("k") == i, v).otherwise(out)
    return out


def put(*pieces):
    return F.concat(*(F.lit(x) if isinstance(x, str) and x[:1] != "$" else F.col(x[1:]).cast("string") if isinstance(x, str) else x for x in pieces))


S_TITLE = "array_to_string(list_transform(string_split({0}, ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
S_PARTS = "(SELECT *, p_partkey % {0} AS k, p_size % 9 + 1 AS season, p_partkey % 20 + 1 AS episode FROM part)"

# ------------------------------------------------------------------ typed titles and file names


@query(f"""SELECT p_partkey, CASE k WHEN 4 THEN upper(p_name) WHEN 5 THEN 'Unknown' ELSE {S_TITLE.format('p_name')} END AS series,
CAST(CASE WHEN k IN (0, 5) THEN 1 ELSE season END AS INTEGER) AS season, CAST(CASE WHEN k IN (0, 5) THEN 1 ELSE episode END AS INTEGER) AS episode FROM {S_PARTS.format(6)}""")
def typed_series(spark, sf_dir):
    """Series, season and episode of what users type."""
    typed = by_kind(put("$p_name"), put(" ", "$p_name", ", season ", "$season", " episode ", "$episode", " "), put("$p_name", " ep ", "$episode", " Season ", "$season"), put("$p_name", " S0", "$season", "E0", "$episode"), put(F.upper("p_name"), "  s ", "$season", " e ", "$episode"), F.lit("  "))
    return parts(spark, sf_dir, 6).select("p_partkey", names.series_input(typed).alias("i")).select("p_partkey", "i.*")


@query(f"""SELECT p_partkey, CASE k WHEN 3 THEN upper(p_name) ELSE {S_TITLE.format('p_name')} END AS movie, CAST(CASE k WHEN 0 THEN 0 WHEN 1 THEN 1990 + season WHEN 2 THEN 2010 + season ELSE 2005 END AS INTEGER) AS year FROM {S_PARTS.format(4)}""")
def typed_movie(spark, sf_dir):
    typed = by_kind(put("$p_name"), put("$p_name", " ", (F.col("season") + 1990).cast("string")), put("$p_name", " (", (F.col("season") + 2010).cast("string"), ")"), put(F.upper("p_name"), ", 2005 "))
    return parts(spark, sf_dir, 4).select("p_partkey", names.movie_input(typed).alias("i")).select("p_partkey", "i.*")


@query(f"""SELECT p_partkey, k IN (1, 2, 3) AS tv, CAST(CASE k WHEN 4 THEN 2001 WHEN 5 THEN 1999 ELSE 0 END AS INTEGER) AS year, CASE WHEN k IN (1, 2, 3) THEN 'tv' WHEN k IN (4, 5) THEN 'movie' ELSE 'ambiguous' END AS intent FROM {S_PARTS.format(6)}""")
def typed_intent(spark, sf_dir):
    """Whether a message names an episode or a year, and what it therefore means."""
    typed = by_kind(put("$p_name"), put("$p_name", " s", "$season", "e", "$episode"), put("$p_name", " Episode ", "$episode"), put("$p_name", " ep", "$episode", " s", "$season"), put("$p_name", " (2001)"), put("$p_name", ", 1999"))
    return parts(spark, sf_dir, 6).select("p_partkey", text.tv_cues(typed).alias("tv"), text.trailing_year(typed).alias("year"), text.media_intent(typed).alias("intent"))


@query(f"SELECT p_partkey, CASE k WHEN 0 THEN 'The ' || p_name ELSE {S_TITLE.format('p_name')} END AS series, CASE k WHEN 0 THEN '2010' WHEN 1 THEN '1999' END AS year FROM {S_PARTS.format(3)}")
def movie_paths(spark, sf_dir):
    slug = F.translate("p_name", " ", "_")
    path = by_kind(put("/m/Movies/The ", "$p_name", "/", slug, "_2010.srt"), put("/x/", slug, "_1999.srt"), put("/x/", F.translate("p_name", " ", "."), ".srt"))
    return parts(spark, sf_dir, 3).select("p_partkey", names.movie_info(path).alias("i")).select("p_partkey", "i.*")


@query(f"SELECT p_partkey, CASE k WHEN 0 THEN 'My ' || p_name ELSE {S_TITLE.format('''replace(p_name, '-', ' ')''')} END AS series, CASE k WHEN 2 THEN NULL ELSE 'Abc' || (10000 + p_partkey) END AS youtube_id FROM {S_PARTS.format(3)}")
def video_paths(spark, sf_dir):
    number = (F.col("p_partkey") + 10000).cast("string")
    path = by_kind(put("/y/YouTube/My ", "$p_name", "/clip_Abc", number, ".srt"), put("/y/", F.translate("p_name", " ", "."), "_Abc", number, ".srt"), put("/y/", F.translate("p_name", " ", "."), ".srt"))
    return parts(spark, sf_dir, 3).select("p_partkey", names.video_info(path).alias("i")).select("p_partkey", "i.*")


@query(f"""SELECT p_partkey, CASE k WHEN 2 THEN 'The Boys' ELSE {S_TITLE.format('p_name')} END AS series, CAST(CASE k WHEN 3 THEN NULL ELSE season END AS INTEGER) AS season, CAST(CASE k WHEN 3 THEN NULL ELSE episode END AS INTEGER) AS episode FROM {S_PARTS.format(4)}""")
def release_names(spark, sf_dir):
    """Series, season and episode of release file names."""
    dots = F.translate("p_name", " ", ".")
    file = by_kind(put("/z/", dots, ".S0", "$season", "E0", "$episode", ".720p.WEB-DL.DDP5.1.x264-GRP.srt"), put("$p_name", " (2019) Season ", "$season", " Episode ", "$episode", " 1080p HDTV-ABC.srt"), put("the.boys.s", "$season", "e", "$episode", ".", dots, ".srt"), put(dots, ".2020.BluRay.srt"))
    return parts(spark, sf_dir, 4).select("p_partkey", names.release_info(file).alias("i")).select("p_partkey", "i.*")


@query(f"""SELECT p_partkey, k IN (0, 1, 2) AS fits FROM {S_PARTS.format(5)}""")
def episode_files(spark, sf_dir):
    """Whether a file name tags season 2, episode 4."""
    file = by_kind(put("$p_name", " S02E04 x"), put("$p_name", ".2x04.srt"), put("$p_name", "_s0002e04."), put("$p_name", " s12e04"), put("$p_name", " s2e41"))
    return parts(spark, sf_dir, 5).select("p_partkey", text.has_season_episode(file, 2, 4).alias("fits"))


@query(r"SELECT page_id, CASE WHEN trim(replace(s, ' ', '_'), '_') = '' THEN 'episode' ELSE trim(s, '_') END AS slug FROM (SELECT page_id, regexp_replace(replace(replace(url, '/', '__'), ' ', '_'), '[^a-zA-Z0-9_.-]+', '_', 'g') AS s FROM pages)")
def folder_slugs(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", names.folder_slug(F.concat(F.lit("/repo/"), "url"), "/repo").alias("slug"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 6 IN (0, 1) THEN 'russian' ELSE 'english_dictionary' END AS mode FROM part")
def translation_modes(spark, sf_dir):
    value = by_kind(F.lit(" RU "), F.lit("Russian"), F.lit("english-dict"), F.lit("en"), F.lit("klingon"), F.lit(None).cast("string"))
    return parts(spark, sf_dir, 6).select("p_partkey", names.translation_mode(value).alias("mode"))


@query("""SELECT CASE event_type WHEN 'view' THEN 'rate_limit' WHEN 'error' THEN 'quota' WHEN 'signup' THEN 'authentication' ELSE 'other' END AS kind, count(*) AS n FROM events GROUP BY 1""")
def error_kinds(spark, sf_dir):
    kind = F.col("event_type")
    message = F.when(kind == "view", "HTTP 429: slow down").when(kind == "error", "You exceeded your current QUOTA (429)").when(kind == "signup", "Unauthorized").otherwise("connection reset")
    return table(spark, sf_dir, "events").groupBy(names.error_kind(message).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, CAST(CASE o_orderkey % 3 WHEN 0 THEN year(o_orderdate) ELSE 0 END AS INTEGER) AS year, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def parsed_dates(spark, sf_dir):
    """Year and day of dates as text, some of them broken."""
    k = F.col("o_orderkey") % 3
    given = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, "soon").otherwise("")
    return table(spark, sf_dir, "orders").select("o_orderkey", names.release_year(given).alias("year"), F.date_format(names.parsed_time(given), "yyyy-MM-dd").alias("day"))


# ------------------------------------------------------------------ texts

S_SPACE = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@query(rf"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\[.*?\]', '', 'g'), '{S_SPACE}', ' ', 'g')) AS plain FROM pages")
def plain_texts(spark, sf_dir):
    """Cleaned text in its own case."""
    return table(spark, sf_dir, "pages").select("page_id", text.plain_text(F.col("html")).alias("plain"))


@query(rf"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\{{[^}}]*\}}', '', 'g'), '(?i)(https?://\S+|www\.\S+)', '', 'g'),
 '(?im)^.*(subtitles by|synced by).*$', '', 'g'), '{S_SPACE}', ' ', 'g')) AS plain FROM (SELECT page_id, html || chr(10) || 'Subtitles by me' || chr(10) || 'see www.x.org {{\an8}} end' AS html FROM pages)""")
def phrasal_texts(spark, sf_dir):
    """Text for phrasal verbs, without links and watermarks."""
    return table(spark, sf_dir, "pages").select("page_id", text.phrasal_text(F.concat("html", F.lit("\nSubtitles by me\nsee www.x.org {\\an8} end"))).alias("plain"))


@query("SELECT doc_id, array_to_string(list_transform(string_split(left(text, 3000), chr(10)), lambda x: left(x, 200)), chr(10)) AS context FROM documents")
def prompt_contexts(spark, sf_dir):
    """What a prompt shows of a text: its first 3000 characters, 200 of each line; the cut is the feature."""
    lines = F.transform(F.split(F.substring("text", 1, 3000), "\n"), lambda x: F.substring(x, 1, 200))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(lines, "\n").alias("context"))


@query("SELECT doc_id, greatest(0, len(string_split(rtrim(text, chr(10)), chr(10))) - 1) AS data_rows FROM documents")
def csv_data_rows(spark, sf_dir):
    """Physical lines of a text below its header line."""
    n = F.size(F.split(F.regexp_replace("text", r"\n+$", ""), "\n")) - 1
    return table(spark, sf_dir, "documents").select("doc_id", F.greatest(F.lit(0), n).cast("long").alias("data_rows"))


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN CAST(doc_id % 12 AS INTEGER) WHEN 1 THEN 7 END AS score_raw, CASE WHEN doc_id % 5 IN (0, 1) AND (doc_id % 5 = 1 OR doc_id % 12 BETWEEN 1 AND 10) THEN CAST(CASE doc_id % 5 WHEN 1 THEN 7 ELSE doc_id % 12 END AS INTEGER) END AS score,
doc_id % 4 < 3 AS bad, doc_id + 100 AS imdb, 'abandon' AS head, '{"a": ' || doc_id || '}' AS plain FROM documents""")
def coerced_answers(spark, sf_dir):
    """Scores, glosses, ids, word-list lines and fenced answers as models and services give them."""
    k = F.col("doc_id")
    given = F.when(k % 5 == 0, (k % 12).cast("string")).when(k % 5 == 1, " 7.0 ").when(k % 5 == 2, "7.5").when(k % 5 == 3, "true")
    gloss = F.when(k % 4 == 0, " N/A").when(k % 4 == 1, None).when(k % 4 == 2, "None ").otherwise("a gloss")
    raw = F.when(k % 5 == 0, (k % 12).cast("int")).when(k % 5 == 1, 7)
    fenced = F.concat(F.lit('```json\n{"a": '), k, F.lit("}\n```"))
    return table(spark, sf_dir, "documents").select("doc_id", raw.alias("score_raw"), text.whole_score(given).alias("score"), text.bad_gloss(gloss).alias("bad"), text.imdb_number(F.concat(F.lit("tt"), (k + 100).cast("string"))).alias("imdb"), text.head_word(F.lit(" Abandon v. B2")).alias("head"), text.unfenced(fenced).alias("plain"))


@query("""SELECT doc_id, '{"a_source":"' || source || '","b_lang":"' || lang || '"}' AS payload, CASE doc_id % 3 WHEN 2 THEN NULL ELSE source END AS rating FROM documents""")
def json_payloads(spark, sf_dir):
    """Payloads with their keys in order, and answers read back under either of two keys."""
    payload = reports.sorted_payload(F.array(F.lit("b_lang"), F.lit("a_source")), F.array("lang", "source"))
    k = F.col("doc_id") % 3
    key = F.when(k == 0, "idiomacy_rating").when(k == 1, "score").otherwise("other")
    answer = F.concat(F.lit('```\n{"'), key, F.lit('": "'), "source", F.lit('"}\n```'))
    return table(spark, sf_dir, "documents").select("doc_id", payload.alias("payload"), reports.answer_fields(answer, "idiomacy_rating", "score").alias("rating"))


# ------------------------------------------------------------------ tags and shown lists

S_THRICE = "|".join(3 * chr(c) for c in range(97, 123))
S_TAGS = f"""{S_TOK}, {S_LISTS}, {S_ENGLISH}, w AS (SELECT DISTINCT word FROM lem),
d AS (SELECT w.word, coalesce(english_frequency, 0) AS english_frequency, {S_LEVEL.format(w='w.word')} AS vocabulary_level, coalesce(filter_class = 'easy', false) AS easy,
  CASE length(w.word) % 4 WHEN 0 THEN 'normal word' WHEN 1 THEN 'Name/Fantasy Entity' WHEN 2 THEN 'odd' END AS said, CASE length(w.word) % 5 WHEN 0 THEN '[Translation failed]' ELSE 'x' END AS gloss
  FROM w LEFT JOIN en USING (word) LEFT JOIN lists USING (word)),
n AS (SELECT *, CASE WHEN ends_with(word, 'th') THEN 'name/fantasy entity (name filter: ' || word || ')' WHEN said = 'Name/Fantasy Entity' THEN 'name/fantasy entity (ChatGPT: Name/Fantasy Entity)'
  WHEN said = 'normal word' AND english_frequency = 0 THEN 'name/fantasy entity (zero frequency - likely proper noun)' WHEN said = 'normal word' THEN 'normal word'
  WHEN said = 'odd' AND starts_with(word, 'a') THEN 'name/fantasy entity (ChatGPT: odd)' WHEN said = 'odd' THEN 'normal word'
  WHEN starts_with(word, 'a') THEN 'name/fantasy entity (ChatGPT: no tag provided)' WHEN english_frequency = 0 THEN 'name/fantasy entity (zero frequency - likely proper noun)' ELSE '' END AS named FROM d),
s AS (SELECT *, CASE WHEN named NOT IN ('', 'normal word') THEN named WHEN vocabulary_level IN ('A1', 'A2') THEN 'simple word (vocabulary level: ' || vocabulary_level || ')' WHEN easy THEN 'simple word (easy_words filter)'
  WHEN vocabulary_level = 'N/A' AND english_frequency > {LEAST_SIMPLE} THEN 'simple word (high frequency: ' || format('{{:,}}', english_frequency) || ', not in vocabulary list)'
  WHEN regexp_matches(word, '{S_THRICE}') THEN 'simple word (informal/non-standard spelling)'
  WHEN length(word) <= 4 AND english_frequency > {LEAST_SIMPLE} THEN 'simple word (short word with high frequency: ' || format('{{:,}}', english_frequency) || ')' ELSE named END AS simple FROM n),
t AS (SELECT word, vocabulary_level, english_frequency, gloss, CASE WHEN gloss = '[Translation failed]' AND simple = 'normal word' AND english_frequency = 0 THEN 'name/fantasy entity (translation failed - zero frequency, likely proper noun)' ELSE simple END AS tag FROM s)"""


def tagged(spark, sf_dir) -> DataFrame:
    """word, vocabulary_level, english_frequency, gloss, tag of every word: the model's tags follow from a word's length."""
    counts = counted(spark, sf_dir)
    rows = tiers.with_dimensions(stored(counts.select("word").distinct()), frequency.english_counts(counts), level_of("word"), list_words(spark, sf_dir))
    n, word, english, level = F.length("word"), F.col("word"), F.col("english_frequency"), F.col("vocabulary_level")
    said = F.when(n % 4 == 0, "normal word").when(n % 4 == 1, "Name/Fantasy Entity").when(n % 4 == 2, "odd")
    gloss = F.when(n % 5 == 0, tags.FAILED).otherwise("x")
    tag = tags.name_tag(word, word.endswith("th"), said, word.startswith("a"), english)
    tag = tags.simple_tag(word, tag, level, F.col("easy"), english, LEAST_SIMPLE)
    return rows.withColumn("gloss", gloss).withColumn("tag", tags.failed_tag(tag, gloss, english)).select("word", "vocabulary_level", "english_frequency", "gloss", "tag")


@query(f"WITH {S_TAGS} SELECT * FROM t")
def word_tags(spark, sf_dir):
    """Name, simple-word and failure tags of every word."""
    return tagged(spark, sf_dir)


@query(f"WITH {S_TAGS} SELECT word, tag FROM t WHERE tag = '' AND vocabulary_level IN ('C1', 'C2', 'N/A')")
def shown_to_level_c(spark, sf_dir):
    return tags.shown(tagged(spark, sf_dir), "C").select("word", "tag")


@query(f"""WITH {S_TAGS}, b AS (SELECT *, tag IN ('', 'normal word') OR vocabulary_level IN ('B1', 'B2', 'C1', 'C2') AS p FROM t)
SELECT length(word) AS letters, count(*) AS original_count, count(*) FILTER (NOT p) AS name_filtered, count(*) FILTER (p AND vocabulary_level NOT IN ('B2', 'C1', 'C2', 'N/A')) AS vocab_filtered,
count(*) FILTER (p AND vocabulary_level IN ('B2', 'C1', 'C2', 'N/A')) AS final_count FROM b GROUP BY 1""")
def bypass_counts(spark, sf_dir):
    """What the name and level filters take of words by length."""
    return tags.bypass_counts(tagged(spark, sf_dir).withColumn("letters", F.length("word").cast("long")), "letters")


@query(f"""WITH {S_TAGS} SELECT vocabulary_level, count(*) AS total_words, count(*) FILTER (english_frequency = 0) AS zero_frequency, count(*) FILTER (english_frequency = 0 AND contains(tag, 'name/fantasy')) AS names_tagged,
count(*) FILTER (english_frequency = 0 AND contains(tag, 'normal word')) AS normal_zero, count(*) FILTER (gloss = '[Translation failed]') AS failed, count(*) FILTER (gloss = '[Translation failed]' AND contains(tag, 'normal word')) AS names_missed FROM t GROUP BY 1""")
def tag_statistics(spark, sf_dir):
    return tags.tag_counts(tagged(spark, sf_dir), "vocabulary_level")


@query("""WITH p AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place, doc_id % 3 = 0 AS c FROM documents)
SELECT source, count(*) AS n, count(*) FILTER (c) AS cyrillic, count(*) FILTER (c) >= greatest(1, count(*) // 3) AS refresh FROM p WHERE place <= 12 GROUP BY source""")
def english_refresh(spark, sf_dir):
    """Lists whose glosses are to be made again; a third of them is Cyrillic here."""
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", F.row_number().over(W.partitionBy("source").orderBy("doc_id")).alias("place"), F.when(F.col("doc_id") % 3 == 0, "слово").otherwise("word").alias("gloss"))
    return tags.needs_english(rows, "source")


def ranked_words(spark, sf_dir, most: int | None = None) -> DataFrame:
    """doc_id, word, n, place, total: a document's words, the most frequent first, ties by first occurrence."""
    return frequency.ranked_words(table(spark, sf_dir, "documents"), most).drop("first_pos")


S_RANKED = "r AS (SELECT doc_id, word, n, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) AS INTEGER) AS place FROM (SELECT doc_id, word, count(*) AS n, min(pos) AS f FROM lem GROUP BY ALL))"


@query(f"WITH {S_TOK}, {S_RANKED} SELECT * FROM r")
def words_by_frequency(spark, sf_dir):
    return ranked_words(spark, sf_dir).drop("total")


@query(f"WITH {S_TOK}, {S_RANKED} SELECT doc_id, word, n, place, max(place) OVER w AS total, max(place) OVER w > 25 AS truncated FROM r WINDOW w AS (PARTITION BY doc_id) QUALIFY place <= 25")
def word_previews(spark, sf_dir):
    """The first 25 words of each document's list, its size and whether it is cut."""
    return ranked_words(spark, sf_dir, 25).withColumn("total", F.col("total").cast("int")).withColumn("truncated", F.col("total") > 25)


@query(f"WITH {S_TOK}, {S_RANKED} SELECT doc_id, place, place || '. *' || word || CASE WHEN n % 2 = 0 THEN ' 📚' ELSE '' END || '* → ' || word || '\\_gloss' AS line FROM r WHERE place <= 15")
def shown_lines(spark, sf_dir):
    """The lines of the first 15 words; those of an even count are saved."""
    rows = ranked_words(spark, sf_dir, 15)
    return rows.select("doc_id", "place", tags.entry_line(F.col("place"), F.col("word"), F.concat("word", F.lit("_gloss")), F.col("n") % 2 == 0).alias("line"))


@query("""WITH u AS (SELECT 0 AS l, p_partkey, p_name AS word, p_type AS gloss FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 1, p_partkey, upper(p_name), p_type FROM part WHERE p_partkey % 2 = 1)
SELECT word, gloss FROM (SELECT *, row_number() OVER (PARTITION BY lower(word), lower(gloss) ORDER BY l, p_partkey) AS k FROM u) WHERE k = 1""")
def merged_word_lists(spark, sf_dir):
    """Two lists as one, an entry of any case only once."""
    given = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("place"), "p_name", F.col("p_type").alias("gloss"))
    one = given.where("place % 2 = 0").select(F.col("p_name").alias("word"), "gloss", "place")
    two = given.where("place % 2 = 1").select(F.upper("p_name").alias("word"), "gloss", "place")
    return tags.merged_lists(one, two).drop("at")


@query(f"WITH {S_LISTS} SELECT filter_class, word, CAST(row_number() OVER (PARTITION BY filter_class ORDER BY lower(word)) AS INTEGER) AS place FROM lists")
def alphabetical_lists(spark, sf_dir):
    """Words with their place in their list: ranges of words are sorted and numbered apart, and start where the ranges before them end."""
    words = list_words(spark, sf_dir).select("filter_class", "word")
    ranges = stored(words.repartitionByRange("filter_class", F.lower("word"), "word").withColumn("range", F.spark_partition_id()))
    sizes = ranges.groupBy("filter_class", "range").agg(F.count(F.lit(1)).alias("size"))
    before = F.sum("size").over(W.partitionBy("filter_class").orderBy("range").rowsBetween(W.unboundedPreceding, -1))  # a row for each range
    starts = sizes.select("filter_class", "range", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(W.partitionBy("filter_class", "range").orderBy(F.lower("word"), "word"))
    return ranges.withColumn("own", own).join(starts, ["filter_class", "range"]).select("filter_class", "word", (F.col("before") + F.col("own")).cast("int").alias("place"))


# ------------------------------------------------------------------ phrases


@query(f"WITH {S_TOP} SELECT doc_id, phrase, n_tokens, n, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n_tokens DESC, n DESC, phrase) AS INTEGER) AS place FROM topk")
def phrases_longest_first(spark, sf_dir):
    return phrases.longest_first(ngram_topk(spark, sf_dir).drop("place"))


@query(f"WITH {S_CANDIDATES} SELECT * FROM cand WHERE length(phrase) % 2 = 0")
def verified_phrases(spark, sf_dir):
    """Candidates that an annotator confirms: phrases of an even length."""
    found = ngrams_filtered(spark, sf_dir)
    return reports.verified(found, found.where(F.length("phrase") % 2 == 0))


@query(rf"""WITH {S_LISTS}, ln AS (SELECT conv_id * 1000000 + turn AS pos, trim(regexp_replace(regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '\[.*?\]', '', 'g'), '\s+', ' ', 'g')) AS line FROM conversations),
c AS (SELECT *, unnest(list_distinct(list_filter(regexp_split_to_array(lower(line), '[^\p{{L}}\p{{N}}_]+'), lambda x: x <> ''))) AS word FROM ln WHERE length(line) > 10 AND NOT regexp_matches(line, '(?i)(downloaded|www\.|http|subtitle\s+by|sync)'))
SELECT word, CAST(row_number() OVER (PARTITION BY word ORDER BY pos, line) AS INTEGER) AS place, line FROM c WHERE word IN (SELECT word FROM lists) QUALIFY place <= 3""")
def legacy_word_examples(spark, sf_dir):
    lines = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("at"), F.col("text").alias("line"))
    return phrases.legacy_examples(lines, list_words(spark, sf_dir))


@query(rf"""WITH {S_LISTS}, ln AS (SELECT conv_id * 1000000 + turn AS pos, trim(regexp_replace(regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '\[.*?\]', '', 'g'), '\s+', ' ', 'g')) AS line FROM conversations),
c AS (SELECT pos, left(line, 220) AS line, unnest(list_distinct(list_filter(regexp_split_to_array(lower(line), '[^\p{{L}}\p{{N}}_]+'), lambda x: x <> ''))) AS phrase FROM ln WHERE length(line) >= 8),
f AS (SELECT phrase, line, min(pos) AS pos FROM c WHERE phrase IN (SELECT word FROM lists) GROUP BY ALL)
SELECT phrase, CAST(row_number() OVER (PARTITION BY phrase ORDER BY pos, line) AS INTEGER) AS place, line FROM f QUALIFY place <= 2""")
def judge_phrase_examples(spark, sf_dir):
    lines = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("at"), F.col("text").alias("line"))
    return phrases.judge_examples(lines, list_words(spark, sf_dir).select(F.col("word").alias("phrase")))


# ------------------------------------------------------------------ judges, plans, reports


def judged_parts(spark, sf_dir) -> DataFrame:
    joined = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.select("source", F.when(F.col("lang") != "de", "ok").otherwise("failed").alias("status"), (F.col("toxic") == 1).alias("skipped"), F.when(F.col("doc_id") % 7 == 0, "boom").alias("error"), F.col("quality").alias("overall_score"))


@query("""WITH p AS (SELECT source, lang <> 'de' AS ok, coalesce(toxic = 1, false) AS sk, doc_id % 7 = 0 AS er, quality FROM documents LEFT JOIN labels USING (doc_id))
SELECT source, sum(quality) FILTER (NOT sk AND NOT er) / count(quality) FILTER (NOT sk AND NOT er) AS mean_score, count(quality) FILTER (NOT sk AND NOT er) AS scored, count(*) FILTER (sk) AS skipped, count(*) FILTER (NOT sk AND er) AS errors FROM p WHERE ok GROUP BY source""")
def judge_matrix(spark, sf_dir):
    return reports.judge_summary(judged_parts(spark, sf_dir), "source")


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN CAST(quality AS DOUBLE) WHEN 1 THEN (quality + toxic) / 2 ELSE 0.0 END AS overall FROM labels")
def judge_overall(spark, sf_dir):
    """Overall scores, or means of the criteria where there is none."""
    k = F.col("doc_id") % 3
    given = lambda c: F.when(k == 1, F.col(c).cast("double"))
    return table(spark, sf_dir, "labels").select("doc_id", reports.overall_score(F.when(k == 0, F.col("quality").cast("double")), given("quality"), given("toxic")).alias("overall"))


@query("SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.quality AS before, b.toxic AS after, b.toxic - a.quality AS gain FROM (SELECT * FROM labels WHERE doc_id % 3 > 0) AS a FULL JOIN (SELECT * FROM labels WHERE doc_id % 5 > 0) AS b ON a.doc_id = b.doc_id")
def compared_judge_runs(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return reports.compared_runs(labels.where("doc_id % 3 > 0").select("doc_id", F.col("quality").alias("score")), labels.where("doc_id % 5 > 0").select("doc_id", F.col("toxic").alias("score")), "doc_id")


ALL_FILES = [x for v in fixed.PART_FILES.values() for x in v]


@query(f"""WITH f AS (SELECT * FROM (VALUES {", ".join(f"('{p}', '{x}', {ALL_FILES.index(x)})" for p, v in fixed.PART_FILES.items() for x in v)}) AS z(part, file, i))
SELECT doc_id AS folder, part, coalesce(string_agg(file, ', ' ORDER BY i) FILTER ((doc_id + i) % 3 = 0), '') AS missing FROM documents, f GROUP BY ALL""")
def missing_artefacts(spark, sf_dir):
    """The files that each part of an episode lacks; a third of all is missing here."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("folder"))
    present = docs.select("folder", F.posexplode(F.lit(ALL_FILES)).alias("i", "file")).where((F.col("folder") + F.col("i")) % 3 != 0).select("folder", "file")
    return reports.missing_parts(present)


@query("SELECT source, count(*) AS words, count(*) FILTER (doc_id % 4 = 3) AS reused, count(*) FILTER (doc_id % 4 < 3) AS to_translate FROM documents GROUP BY source")
def gloss_reuse(spark, sf_dir):
    k = F.col("doc_id") % 4
    gloss = F.when(k == 0, "N/A").when(k == 1, None).when(k == 2, " none ").otherwise("ok")
    return reports.reuse_counts(table(spark, sf_dir, "documents").select("source", gloss.alias("gloss")), "source")


@query("""WITH c AS (SELECT p_brand AS query, CASE WHEN p_partkey % 3 > 0 THEN p_partkey END AS id, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS place FROM part)
SELECT query, id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY place) - 1 AS rank FROM c WHERE id IS NOT NULL) WHERE rank BETWEEN 1 AND 2""")
def title_alternatives(spark, sf_dir):
    """The runners-up with an id."""
    place = F.row_number().over(W.partitionBy("p_brand").orderBy(F.desc("p_size"), "p_partkey"))
    found = table(spark, sf_dir, "part").select(F.col("p_brand").alias("query"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_partkey")).alias("id"), place.alias("place"))
    return reports.alternatives(found).select("query", "id", "rank")


@query("""WITH m AS (SELECT p_partkey, p_brand, p_size, (contains(lower(p_name), 'blue') OR contains(lower(p_type), 'blue'))::INT + (contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring'))::INT AS hits FROM part),
s AS (SELECT *, floor((hits / 2 * 0.7 + least(log10(p_size + 1) / 10, 1.0) * 0.3) * 1000000) AS score FROM m)
SELECT p_brand, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey) AS INTEGER) AS place FROM s QUALIFY place <= 5""")
def relevance_order(spark, sf_dir):
    """The five most relevant files of each brand for 'Blue Ring'."""
    match = text.match_score(F.lit("Blue Ring"), F.col("p_name"), F.col("p_type"))
    scored = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.floor(reports.relevance(match, F.col("p_size")) * 1000000).alias("score"))
    place = F.row_number().over(W.partitionBy("p_brand").orderBy(F.desc("score"), "p_partkey"))
    return scored.select("p_brand", "p_partkey", place.alias("place")).where("place <= 5")


@query("""WITH s AS (SELECT 0 AS q, n_name AS name, CAST(e AS INTEGER) AS episode, row_number() OVER (ORDER BY e, n_nationkey) AS turn FROM (SELECT *, unnest(range(1, n_regionkey + 2)) AS e FROM nation)),
f AS (SELECT 1 AS q, s_name AS name, NULL AS episode, row_number() OVER (ORDER BY s_suppkey) AS turn FROM supplier)
SELECT CAST(row_number() OVER (ORDER BY turn, q) AS INTEGER) AS place, name, episode FROM (SELECT * FROM s UNION ALL SELECT * FROM f) ORDER BY turn, q LIMIT 68""")
def daily_plan(spark, sf_dir):
    """The day's downloads: nations are shows, suppliers are films, 12 of 80 are used."""
    shows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("show_pos"), F.col("n_name").alias("name"), (F.col("n_regionkey") + 1).alias("episodes"))
    films = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pos"), F.col("s_name").alias("name"))
    return reports.daily_plan(shows, films, 12)


@query("SELECT '2024-01-05' AS day, CASE WHEN strftime(ts, '%Y-%m-%d') = '2024-01-05' THEN count(*) ELSE 0 END AS used FROM events GROUP BY strftime(ts, '%Y-%m-%d')")
def daily_states(spark, sf_dir):
    """The budget used on 2024-01-05, from the states of all days."""
    state = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("date")).agg(F.count(F.lit(1)).alias("new_downloads_today"))
    return reports.daily_state(state, F.lit("2024-01-05"))


@query(f"""WITH {S_EVENTS}, u AS (SELECT user_id, count(*) AS events_total, count(*) FILTER (event_type = 'click') AS click_count, max(ts) AS last_seen FROM ev GROUP BY user_id)
SELECT * FROM u ORDER BY last_seen DESC, user_id LIMIT 20""")
def monitoring_report(spark, sf_dir):
    """The twenty users last seen."""
    return reports.monitoring(activity.with_action(table(spark, sf_dir, "events"))).select("user_id", "events_total", "click_count", "last_seen")


@query("SELECT event_id, user_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 120")
def latest_events(spark, sf_dir):
    return reports.latest_of_all(table(spark, sf_dir, "events")).select("event_id", "user_id", "ts")


@query("""WITH s AS (SELECT *, lead(event_type) OVER w AS then_, lead(ts) OVER w AS until FROM events WHERE event_type IN ('click', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT user_id, epoch_us(until) - epoch_us(ts) AS us FROM s WHERE event_type = 'click' AND then_ = 'purchase')
SELECT user_id, count(*) AS runs, CAST(sum(us) // 1000 AS BIGINT) AS total_ms, CAST(sum(us) // count(*) AS BIGINT) AS avg_us FROM r GROUP BY ROLLUP (user_id)""")
def pipeline_totals(spark, sf_dir):
    """Runs and times of each user and, with a null user, of all."""
    out = reports.pipeline_totals(activity.pairs(table(spark, sf_dir, "events"), "click", "purchase"), "user_id")
    return out.select("user_id", "runs", "total_ms", F.floor(F.round(F.col("avg_seconds") * 1e6, 3)).alias("avg_us"))


@query("SELECT max(n_regionkey + 1) AS most FROM nation")
def most_episodes(spark, sf_dir):
    return table(spark, sf_dir, "nation").agg(F.max(F.col("n_regionkey") + 1).alias("most"))


@query("""WITH x AS (SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS a, list_distinct(string_split(lower(p_name || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' extra' ELSE ' one two three' END), ' ')) AS b FROM part)
SELECT p_partkey, len(list_intersect(a, b)) / greatest(len(a), len(b)) >= 0.6 AS agrees FROM x""")
def title_agreement(spark, sf_dir):
    """Whether a title and its folder, some with words added, agree."""
    folder = by_kind(put("$p_name"), put("$p_name", " extra"), put("$p_name", " one two three"))
    return parts(spark, sf_dir, 3).select("p_partkey", text.titles_agree(F.col("p_name"), folder).alias("agrees"))


@query(f"""WITH {S_TOK}, {S_RANKED}, z AS (SELECT doc_id, word, place, (row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1) // 20 AS part FROM r WHERE length(word) = 7)
SELECT doc_id, part, count(*) AS words, string_agg(word, ', ' ORDER BY place) AS batch FROM z GROUP BY doc_id, part""")
def prompt_batches(spark, sf_dir):
    """All words of seven letters that an annotator is asked about, in batches of twenty, each document's in order of frequency."""
    asked = ranked_words(spark, sf_dir).where(F.length("word") == 7)
    numbered = asked.withColumn("part", F.floor((F.row_number().over(W.partitionBy("doc_id").orderBy("place")) - 1) / 20))
    told = F.array_sort(F.collect_list(F.struct("place", "word")))  # twenty at most
    return numbered.groupBy("doc_id", "part").agg(F.count(F.lit(1)).alias("words"), F.array_join(F.transform(told, lambda x: x["word"]), ", ").alias("batch"))
