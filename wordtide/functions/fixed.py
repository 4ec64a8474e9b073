"""Word lists and constants that results depend on."""

# Fixed values, in the order in which they are defined. A phrase listed twice counts twice.
PARTICLES = [
    "up", "down", "out", "in", "on", "off", "away", "back", "over", "through", "around", "about", "along", "across",
    "by", "for", "with", "to", "into", "onto", "upon", "after", "before", "ahead", "aside", "apart", "together",
]
THIRD_WORDS = ["with", "for", "on", "in", "at", "by"]
PHRASAL_VERBS = [
    "give up", "look for", "turn on", "turn off", "put on", "take off", "get up", "sit down", "come in", "go out",
    "come back", "go back", "look up", "look down", "look out", "look after", "look into", "find out", "figure out",
    "work out", "point out", "turn out", "break down", "break up", "break in", "break out", "break through",
    "bring up", "bring in", "bring out", "bring back", "bring about", "call off", "call up", "call on", "call for",
    "call back", "come up", "come down", "come out", "come in", "come across", "go on", "go off", "go through",
    "go over", "go along", "pick up", "pick out", "pick on", "put down", "put off", "put up", "put out",
    "put together", "take on", "take in", "take over", "take up", "turn around", "turn down", "turn up", "wake up",
    "wake up", "stand up", "stand by", "stand for", "set up", "set out", "set off", "set about", "show up",
    "show off", "shut down", "shut up", "shut off", "shut in", "run into", "run out", "run over", "run away",
    "run across", "make up", "make out", "make for", "make off", "make over", "get on", "get off", "get in",
    "get out", "get back", "get up", "get down", "get over", "get through", "get along", "keep up", "keep on",
    "keep off", "keep out", "keep away", "hold on", "hold up", "hold back", "hold out", "hold off", "move on",
    "move in", "move out", "move over", "move along", "carry on", "carry out", "carry over", "carry off",
    "carry away", "check in", "check out", "check up", "check on", "check off", "fill in", "fill out", "fill up",
    "end up", "wind up", "catch up", "catch on", "catch out", "deal with", "do with", "do without", "go with",
    "go without", "come up with", "put up with", "keep up with", "give in", "give out", "give away", "give back",
    "give off", "let in", "let out", "let down", "let up", "let go", "pass away", "pass out", "pass on", "pass by",
    "pass through", "pull off", "pull out", "pull over", "pull through", "pull together", "push on", "push through",
    "push ahead", "push forward", "push back", "send off", "send out", "send away", "send back", "send in",
    "throw away", "throw out", "throw off", "throw up", "throw in", "try on", "try out", "try for", "try back",
    "wear out", "write down", "write up", "write out", "write off", "write back",
]
FRAGMENTS = ["s", "t", "m", "re", "ve", "ll", "d"]
STOP_WORDS = sorted(set("""
a an the and or but if so as at by for from in into of on onto to too
up down out off over with without about above after again against all
almost also always am any are around as be been being both can could
did do does doing done each else ever every few for get got had has have
having he her here hers him his how i if in is it its just least like
ll me more most much my no nor not now of off on once only or other our
ours out re s same she should so some such than that the their them
then there these they this those through to too under until ve very was
we were what when where which while who whom why will with would yet
you your yours
""".split()))
BORING_NGRAMS = [
    x.strip()
    for x in """
one of the, some of the, any of the, most of the, many of the, much of the, none of the,
part of the, end of the, out of the, top of the, rest of the, middle of the, bottom of the,
front of the, back of the, side of the, lot of the, kind of the, sort of the, couple of the,
number of the, bit of the, piece of the, i don t know, i do not know, you know what,
what do you, what are you, what is your, what s your, i want to, i need to, i have to,
i got to, going to be, have to be, has to be, had to be, there is a, there are a,
this is the, that is the, it s a, it is a, the first time, for the first time,
a civil war, the civil war, a hundred percent, one hundred percent, it is a big deal,
this is a big deal, i m gonna, i am gonna, this wasn t, this was not, ruin my life,
having the best time, the quiet room, ride the carousel, lot of shit
""".replace("\n", " ").split(",")
]
TRAILING_JUNK = ["and", "or", "the", "a", "an", "to", "of", "in", "on", "for"]

LEVELS = ["A1", "A2", "B1", "B2", "C1", "C2"]
TIERS = ["tier_1_hard_usable", "tier_2_random", "tier_3_common", "tier_4_rare_in_series", "tier_5_filtered", "tier_b1_words", "tier_b2_words"]
MIN_LENGTH, MIN_EPISODE_COUNT, MAX_ENGLISH_FREQ = 3, 3, 20_000_000
NGRAM_LEAST, NGRAM_MOST, NGRAM_OCCURRENCES, NGRAM_CANDIDATES, STOP_RATIO = 3, 6, 2, 220, 0.65
IDIOM_GATE, PHRASAL_IDIOM_GATE, PHRASAL_LITERAL_GATE = 5, 6, 3
TITLE_HIGH, TITLE_LEAST, TITLE_GAP, TITLE_CLEAR_GAP = 0.88, 0.70, 0.12, 0.15
RECENT_ALL, RECENT_USER = 120, 30
DAILY_DOWNLOADS, DAILY_SHOWS, DAILY_MOVIES, FAILURE_STREAK = 80, 20, 40, 8
SIMPLE_WORD_FREQ = 2_000_000

# What a file name's release carries beside the title, removed in this order; True: in any case.
RELEASE_NOISE = [
    (r"\s*\(\d{4}\)", "", False),
    (r"\.\d{4}\.", ".", False),
    (r"s\d+e\d+", "", True),
    (r"season\s*\d+", "", True),
    (r"episode\s*\d+", "", True),
    (r"\d+p", "", True),
    (r"WEB[- ]?DL", "", True),
    (r"HDTV", "", True),
    (r"BluRay", "", True),
    (r"DVDrip", "", True),
    (r"AMZN", "", True),
    (r"x264", "", True),
    (r"H\.?264", "", True),
    (r"DDP?5\.?1", "", True),
    (r"Atmos", "", True),
    (r"-[A-Z0-9-]+$", "", False),
    (r"\([A-Z0-9-]+\)$", "", False),
]
KNOWN_SERIES = ["Game of Thrones", "The Boys", "Fallout", "Friends"]
# How a season and an episode are typed at the end of a title; True: the season comes first.
TYPED_EPISODES = [
    (r"\b[sS](?:eason)?\s*(\d+)\s*[eE](?:p(?:isode)?)?\s*(\d+)\s*$", True),
    (r"\b[eE](?:p(?:isode)?)?\s*(\d+)\s*[sS](?:eason)?\s*(\d+)\s*$", False),
]
TYPED_YEAR = r"\(?(19\d{2}|20\d{2})\)?\s*$"
# Names of the translation modes, and words that tell an API error's kind, the first kind that fits.
MODES = {"russian": ["russian", "ru", "rus"], "english_dictionary": ["english_dictionary", "english", "en", "dictionary", "dict", "english_dict"]}
ERROR_KINDS = {
    "quota": ["quota", "insufficient_quota", "billing", "payment", "credit", "exceeded"],
    "rate_limit": ["rate limit", "rate_limit", "too many requests", "429"],
    "authentication": ["invalid", "unauthorized", "401", "403", "authentication", "api key"],
}
# Watermarks that example lines lose, and words that mark a line as metadata.
WATERMARKS = [r"(?i)downloaded\s+from\s+www\.[^\s]+", r"(?i)www\.[^\s]+", r"(?i)http[s]?://[^\s]+", r"(?i)subtitle[s]?\s+by\s+[^\n]+", r"(?i)sync[ed]?\s+by\s+[^\n]+"]
METADATA = r"(?i)(downloaded|www\.|http|subtitle\s+by|sync)"
# Levels shown to a user, levels that names pass with, levels of the bypass filter.
SHOWN_LEVELS = {"A": None, "B": ["B1", "B2", "C1", "C2", "N/A", ""], "C": ["C1", "C2", "N/A", ""]}
BYPASS_LEVELS, ALLOWED_LEVELS = ["B1", "B2", "C1", "C2"], ["B2", "C1", "C2", "N/A", ""]
# Files of an episode's parts.
PART_FILES = {
    "frequent_c": ["tier_1_hard_usable_translations.csv"],
    "frequent_b": ["tier_b1_words_translations.csv", "tier_b2_words_translations.csv"],
    "rare_c": ["tier_4_rare_c_translations.csv"],
    "rare_b": ["tier_4_rare_b_translations.csv"],
    "phrasal": ["phrasal_verbs.csv"],
    "idioms": ["idiomatic_expressions.csv"],
}
