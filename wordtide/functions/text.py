"""Text columns: cleaning, words, singular forms, sentences, titles, urls, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TIMING = r"\d{2}:\d{2}:\d{2}[,.]\d{3}\s*-->\s*\d{2}:\d{2}:\d{2}[,.]\d{3}"
YOUTUBE = r"(?:https?://)?(?:www\.|m\.)?(?:youtube\.com/(?:watch\?v=|shorts/|embed/)|youtu\.be/)([A-Za-z0-9_-]{6,})"


def _replaced(text: Column, *steps: tuple[str, str]) -> Column:
    for pattern, by in steps:
        text = F.regexp_replace(text, pattern, by)
    return text


def cleaned(text: Column) -> Column:
    """Subtitle text without timing lines, index lines, tags and brackets; text without a digit or an opening bracket stays as it is."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(text.rlike(r"[\d<\[]"), _replaced(text, (TIMING, ""), (r"(?m)^\d+$", ""), (r"<[^>]+>", ""), (r"\[.*?\]", ""))).otherwise(text)


def plain_text(text: Column) -> Column:
    """Cleaned text in its own case, white space collapsed."""
    return F.trim(_replaced(cleaned(text), (r"(?U)[\s\x1c-\x1f]+", " ")))


def phrasal_text(text: Column) -> Column:
    """Text for phrasal verbs: brackets stay, player tags, links and watermarks go."""
    return F.trim(_replaced(text, (TIMING, ""), (r"(?m)^\d+$", ""), (r"<[^>]+>", ""), (r"\{[^}]*\}", ""), (r"(?i)(https?://\S+|www\.\S+)", ""), (r"(?im)^.*(subtitles by|synced by).*$", ""), (r"(?U)[\s\x1c-\x1f]+", " ")))


def words(text: Column) -> Column:
    """Lower-case a-z words in text order; words with an inner apostrophe are no words."""
    word = r"[\p{L}\p{N}\p{M}_']"
    return F.regexp_extract_all(F.lower(cleaned(text)), F.lit(rf"(?<!{word})'*+([a-z]++)'*+(?!{word})"), F.lit(1))


def tokens(text: Column) -> Column:
    """Lower-case word tokens (letters, digits, underscores) in text order."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda x: x != "")


def spaced_tokens(text: Column) -> Column:
    """Tokens as ``tokens``, with ``|`` wherever neighbours aren't parted by exactly one space."""
    marked = _replaced(F.lower(text), (r"[^\p{L}\p{N}_ ]| {2,}", " | "))
    return F.filter(F.split(marked, " +"), lambda x: x != "")


def joined_tokens(text: Column) -> Column:
    """Tokens as ``tokens``, with ``|`` wherever neighbours are parted by more than white space."""
    marked = _replaced(F.lower(text), (r"[^\p{L}\p{N}_\s]", " | "))
    return F.filter(F.split(marked, r"\s+"), lambda x: x != "")


def singular(word: Column) -> Column:
    """Rule-based singular."""
    w, n = F.lower(word), F.length(word)
    cut = lambda k: F.substr(w, F.lit(1), n - k)
    ends = lambda *xs: w.rlike(f"({'|'.join(xs)})$")
    return (
        F.when(n <= 3, word)
        .when(ends("ies") & (n > 4), F.concat(cut(3), F.lit("y")))
        .when(ends("ches", "shes", "xes", "zes", "ses") & (n > 4), cut(2))
        .when(ends("ves") & (n > 4), F.concat(cut(3), F.lit("f")))
        .when(ends("s") & ~ends("ss", "us", "is", "as", "os"), cut(1))
        .otherwise(w)
    )


def singular_for_levels(word: Column) -> Column:
    """The variant of ``singular`` that level lookups use."""
    w, n = F.lower(word), F.length(word)
    cut = lambda k: F.substr(w, F.lit(1), n - k)
    return (
        F.when(w.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when(w.endswith("ves"), F.concat(cut(3), F.lit("f")))
        .when(w.endswith("es") & (n > 3), F.when(F.substr(w, n - 2, F.lit(1)).isin("s", "x", "z"), cut(2)).otherwise(w))
        .when(w.endswith("s") & (n > 1), cut(1))
        .otherwise(w)
    )


def sentences(text: Column, least: int = 10, most: int = 260) -> Column:
    """Sentences of more than ``least`` and fewer than ``most`` characters, in order."""
    parts = F.transform(F.split(text, r"[.!?]+"), lambda x: F.trim(_replaced(x, (r"^\s+|\s+$", ""))))
    return F.filter(parts, lambda x: (F.length(x) > least) & (F.length(x) < most))


def cue_lines(content: Column, least: int = 10) -> Column:
    """The text line of every cue block of SRT content: (pos, line), blocks of three lines or more."""
    blocks = F.split(content, r"\n\s*\n")
    lines = lambda b: F.filter(F.transform(F.split(b, "\n"), F.trim), lambda x: x != "")
    spoken = lambda b: F.filter(lines(b), lambda x: ~x.rlike(r"^\d+$") & ~x.rlike(f"^{TIMING}"))
    text = lambda b: F.trim(_replaced(F.array_join(spoken(b), " "), (r"<[^>]+>", ""), (r"\[.*?\]", ""), (r"(?U)\s+", " ")))
    cues = F.transform(blocks, lambda b, i: F.struct(i.alias("pos"), F.size(lines(b)).alias("n"), text(b).alias("line")))
    return F.filter(cues, lambda c: (c["n"] >= 3) & (F.length(c["line"]) >= least))


def normal_title(title: Column) -> Column:
    """Lower case, punctuation as spaces, white space collapsed."""
    return F.trim(_replaced(F.lower(F.coalesce(title, F.lit(""))), (r"[^\p{L}\p{N}_\s]", " "), (r"\s+", " ")))


def slug(title: Column, empty: str = "series") -> Column:
    """File-name form: lower case, unsafe characters dropped, hyphens and spaces as one underscore."""
    s = _replaced(F.lower(F.trim(title)), (r"[^\p{L}\p{N}_\s-]", ""), (r"[-\s]+", "_"), (r"^_+|_+$", ""))
    return F.when(s == "", empty).otherwise(s)


def title_case(text: Column) -> Column:
    """Every letter after a non-letter upper-cased, the others lower-cased."""
    lower = F.lower(text)
    letters = F.split(lower, "")
    return F.array_join(F.transform(letters, lambda x, i: F.when((i == 0) | ~F.element_at(letters, F.greatest(i, F.lit(1))).rlike(r"\p{L}"), F.upper(x)).otherwise(x)), "")


def series_info(stem: Column) -> Column:
    """struct(series, season, episode) of a file name without its suffix."""
    tag = r"[Ss](\d+)[Ee](\d+)"
    season, episode = F.regexp_extract(stem, tag, 1), F.regexp_extract(stem, tag, 2)
    found = season != ""
    name = F.when(found, _replaced(F.regexp_extract(stem, r"^(.*?)[Ss]\d+[Ee]\d+", 1), (r"^[._]+|[._]+$", ""))).otherwise(stem)
    name = F.trim(F.translate(_replaced(name, (r"\.(19|20)\d{2}$", "")), "._", "  "))
    name = F.when((name != "") & ~F.substr(name, F.lit(2)).rlike(r"\p{Lu}"), title_case(name)).otherwise(name)
    two = lambda letter, x: F.when(found, F.concat(F.lit(letter), F.lpad(x.try_cast("int").cast("string"), 2, "0")))
    return F.struct(F.when(name == "", "Unknown").otherwise(name).alias("series"), two("S", season).alias("season"), two("E", episode).alias("episode"))


def has_season_episode(name: Column, season: int, episode: int) -> Column:
    """A file name that tags this season and episode."""
    low = F.lower(F.coalesce(name, F.lit("")))
    plain = [f"s{season:02d}e{episode:02d}", *(f"{s}x{e}" for s in (season, f"{season:02d}") for e in (episode, f"{episode:02d}"))]
    out = low.rlike(rf"(?<![0-9])s0*{season}e0*{episode}(?![0-9])")
    for x in plain:
        out = out | low.contains(x)
    return out


def tv_cues(text: Column) -> Column:
    """Text that names a season or an episode."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return t.rlike(r"\b[sS](?:eason)?\s*\d+\s*[eE](?:p(?:isode)?)?\s*\d+") | t.rlike(r"\b[eE](?:p(?:isode)?)?\s*\d+\s*[sS](?:eason)?\s*\d+") | t.rlike(r"(?i)\b(?:season|episode)\s+\d+")


def trailing_year(text: Column) -> Column:
    """The release year at the end of a title, else 0."""
    year = F.regexp_extract(F.trim(F.coalesce(text, F.lit(""))), r"(?:^|[\s,;])(?:\(?(19\d{2}|20\d{2})\)?)\s*$", 1)
    return F.coalesce(year.try_cast("int"), F.lit(0))


def media_intent(raw: Column, mode: str = "series") -> Column:
    """movie, tv or ambiguous."""
    if mode == "movie":
        return F.lit("movie")
    return F.when(tv_cues(raw), "tv").when(trailing_year(raw) > 0, "movie").otherwise("ambiguous")


def youtube_id(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), YOUTUBE, 1)


def stripped_markup(text: Column) -> Column:
    """Captions without inline timestamps and tags."""
    return F.trim(_replaced(text, (r"<\d{1,2}:\d{2}:\d{2}\.\d{3}>", ""), (r"<[^>]+>", "")))


def srt_timestamp(vtt: Column) -> Column:
    t = F.trim(vtt)
    t = F.when(t.rlike(r"^\d{1,2}:\d{2}\.\d{3}$"), F.concat(F.lit("00:"), t)).when(t.rlike(r"^\d{1,2}\.\d{3}$"), F.concat(F.lit("00:00:"), t)).otherwise(t)
    return F.translate(t, ".", ",")


def ellipsis(text: Column, limit: int = 120) -> Column:
    """Newlines as spaces, trimmed, cut to ``limit`` with dots."""
    t = F.trim(F.translate(F.coalesce(text, F.lit("")), "\n", " "))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, limit - 1)), F.lit("...")))


def link_token(word: Column, gloss: Column) -> Column:
    """The first 16 hex digits of the SHA-1 of ``word::gloss``."""
    return F.substring(F.sha1(F.concat(word, F.lit("::"), gloss).cast("binary")), 1, 16)


def base64url(text: Column) -> Column:
    """URL-safe base64 without padding, in one line: Spark's breaks lines after 76 characters."""
    return F.translate(F.base64(text.cast("binary")), "+/=\r\n", "-_")


def from_base64url(text: Column) -> Column:
    padded = F.concat(F.translate(text, "-_", "+/"), F.repeat(F.lit("="), (4 - F.length(text) % 4) % 4))
    return F.unbase64(padded).cast("string")


def popularity(downloads: Column) -> Column:
    return F.least(F.log10(downloads + 1) / 10, F.lit(1.0))


def match_score(query: Column, filename: Column, release: Column) -> Column:
    """Share of the query's distinct words that the file name or release holds; little counts less."""
    asked = F.array_distinct(F.filter(F.split(normal_title(query), " "), lambda x: x != ""))
    fn, rel = F.lower(F.coalesce(filename, F.lit(""))), F.lower(F.coalesce(release, F.lit("")))
    hits, n = F.size(F.filter(asked, lambda w: fn.contains(w) | rel.contains(w))), F.size(asked)
    score = hits / n
    return F.when(n == 0, 0.0).when(hits < n * 0.5, score * 0.3).otherwise(score)


def title_overlap(a: Column, b: Column) -> Column:
    """Shared distinct words over the larger number of them."""
    x, y = (F.array_distinct(F.filter(F.split(normal_title(t), " "), lambda w: w != "")) for t in (a, b))
    most = F.greatest(F.size(x), F.size(y))
    return F.when(most == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / most)


def titles_agree(a: Column, b: Column, least: float = 0.6) -> Column:
    """A subtitle's title and its folder's share enough words."""
    return title_overlap(a, b) >= least


def span(seconds: Column) -> Column:
    """Ns, Nm Ns, Nh Nm or Nd Nh."""
    s = F.greatest(F.lit(0), seconds.cast("bigint"))
    put = lambda a, x, b, y: F.concat(a.cast("string"), F.lit(x + " "), b.cast("string"), F.lit(y))
    m, h, d = F.floor(s / 60), F.floor(s / 3600), F.floor(s / 86400)
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(m < 60, put(m, "m", s % 60, "s")).when(h < 48, put(h, "h", m % 60, "m")).otherwise(put(d, "d", h % 24, "h"))


def unfenced(text: Column) -> Column:
    """A model's answer without its Markdown fence."""
    return F.trim(_replaced(F.trim(text), (r"^```(?:json)?\s*", ""), (r"\s*```$", "")))


def whole_score(value: Column) -> Column:
    """A score of 1 to 10 given as a whole number or digits, else null."""
    n = F.when(F.trim(value).rlike(r"^[+-]?\d+(\.0+)?$"), F.trim(value).try_cast("double").cast("int"))
    return F.when((n >= 1) & (n <= 10), n)


def bad_gloss(text: Column) -> Column:
    return text.isNull() | F.lower(F.trim(text)).isin("", "n/a", "none", "null")


def head_word(line: Column) -> Column:
    """The head word of a word-list line such as ``abandon v. B2``."""
    return F.lower(F.regexp_extract(line, r"^\s*([A-Za-z][A-Za-z'-]*)", 1))


def imdb_number(imdb_id: Column) -> Column:
    return F.regexp_extract(F.coalesce(imdb_id, F.lit("")), r"(\d+)", 1).try_cast("bigint")
