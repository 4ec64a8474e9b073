"""Segmentation and naive Bayes of the URL filter, against plain loops."""

import math
import random
import re
from collections import Counter

import numpy as np

from wordtide.llm import url_filter


def best_split(token, counts, total):
    """The highest log probability of any split, by recursion over all starts."""
    best = [0.0]
    for end in range(1, len(token) + 1):
        word = lambda s: token[s:end]
        p = lambda w: math.log(counts[w] / total) if w in counts else -math.log1p(total / 10) - len(w) * math.log(10)
        best.append(max(best[s] + p(word(s)) for s in range(end)))
    return best[-1]


def score(words, counts, total):
    return sum(math.log(counts[w] / total) if w in counts else -math.log1p(total / 10) - len(w) * math.log(10) for w in words)


def test_viterbi_against_all_splits():
    rng = random.Random(3)
    for _ in range(60):
        counts = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 5))): rng.randint(1, 50) for _ in range(6)}
        total, token = float(sum(counts.values()) * rng.choice([1, 9, 900])), "".join(rng.choice("abc") for _ in range(rng.randint(0, 25)))
        found = [(m, len(w), n) for w, n in counts.items() for m in range(len(token)) if token.startswith(w, m)]
        words = url_filter.viterbi(token, *(np.array(x, np.int64) for x in (zip(*found) if found else ([], [], []))), total)
        assert "".join(words) == token and abs(score(words, counts, total) - best_split(token, counts, total)) < 1e-9


def test_runs_and_words_of_any_length(spark):
    long = "q" * 45
    counts = spark.createDataFrame([("good", 50), ("day", 40), (long, 3), ("x", 900)], "word string, n long")
    asked = [("goodday" * 60, ["good", "day"] * 60), (f"good{long}day", ["good", long, "day"]), ("zz" * 500, ["zz" * 500]), ("goodday", ["good", "day"])]
    got = {r["token"]: r["words"] for r in url_filter.segmented(spark.createDataFrame([(t,) for t, _ in asked], "token string"), counts).collect()}
    assert got == dict(asked)


def test_op7_against_plain_loops(spark, tmp_path):
    rng = random.Random(8)
    words = ["tea", "spam", "blue", "wood", "cash", "news"]
    hosts = ["example.com", "www.example.com", "spamcash.net", "teawood.net", "bluenews.org", "cashspam.org", "woodtea.io", "x9.net"]
    data = []
    for i in range(400):
        host, lang = rng.choice(hosts), rng.choice(["en", "es", "fr", "de"])
        data.append((i, f"https://{host}/{lang}/{rng.choice(words)}{rng.choice(words)}/{rng.randint(1, 99)}" + rng.choice(["", "?a=/es/", "#x"]), "<b>" + " ".join(rng.choice(words) for _ in range(5)) + "</b>", "h", "w"))
    data += [(900, None, None, "h", "w"), (901, "no scheme", "", "h", "w"), (1, data[1][1], "", "h", "w")]
    spark.createDataFrame(data, "page_id long, url string, html string, host string, word string").write.parquet(str(tmp_path / "pages.parquet"))
    got = url_filter.op7_url_filter(spark, str(tmp_path)).collect()

    vocabulary = Counter(w for *_, html, _, _ in data for w in re.findall(r"[^\W\d_]+", re.sub(r"<[^>]*>", " ", (html or "").lower())))
    total = float(sum(vocabulary.values()))

    def parts(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        return host.lower(), re.match(r"[^?#]*", rest[len(host) :])[0]

    def ruled(host, path):
        fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1:] if fits else (None, None)

    def tokens(text):
        out = []
        for t in re.findall(r"[^\W\d_]+|\d+", text.lower()):
            if t[0].isdigit():
                out.append(f"#{len(t)}")
                continue
            found = [(m, len(w), n) for w, n in vocabulary.items() for m in range(len(t)) if t.startswith(w, m)]
            out += url_filter.viterbi(t, *(np.array(x, np.int64) for x in (zip(*found) if found else ([], [], []))), total)
        return out

    seen = {"allow": Counter(), "block": Counter()}
    judged = Counter()
    for _, url, *_ in data:
        host, path = parts(url)
        verdict = ruled(host, path)[1]
        if verdict:
            judged[verdict] += 1
            seen[verdict].update([("host", w) for w in tokens(host)] + [("path", w) for w in tokens(path)])
    kinds = set(seen["allow"]) | set(seen["block"])

    def verdict(host, path):
        v = math.log((judged["allow"] + 1) / (judged["block"] + 1))
        everything = [("host", w) for w in tokens(host)] + [("path", w) for w in tokens(path)]
        sizes = {k: sum(c.values()) + len(all_words) + 1 for k, c in seen.items()}
        return v + sum(math.log((seen["allow"][x] + 1) / sizes["allow"]) - math.log((seen["block"][x] + 1) / sizes["block"]) for x in everything)

    all_words = kinds | {(side, w) for _, url, *_ in data for side, text in zip(("host", "path"), parts(url), strict=True) for w in tokens(text)}
    assert len(got) == len(data)
    for r in got:
        url = dict((d[0], d[1]) for d in data)[r["page_id"]]
        host, path = parts(url)
        rule, own = ruled(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        if own:
            assert r["verdict"] == own and r["score"] is None
        else:
            want = verdict(host, path)
            assert abs(r["score"] - want) < 1e-6 and r["verdict"] == ("allow" if want >= 0 else "block")


def test_a_run_of_a_million_letters(spark):
    """Words of one and two letters and one of twenty thousand; without a substring written for each place and length."""
    draw = random.Random(4)
    long = "".join(draw.choice("abcd") for _ in range(20_000))
    run = "ab" * 240_000 + long + "xyz" * 166_666 + "ab"
    counts = spark.createDataFrame([("a", 50), ("ab", 900), (long, 3)], "word string, n long")
    got = url_filter.segmented(spark.createDataFrame([(run,), (run,), ("",)], "token string"), counts).collect()
    assert {r["token"]: r["words"] for r in got} == {run: ["ab"] * 240_000 + [long, "xyz" * 166_666, "ab"], "": []}


def test_substring_hashes():
    run = "straße日本abcabc"
    sums, inverse = url_filter.prefix_hashes(run)
    for size in (1, 3, 5):
        own = url_filter.substring_hashes(sums, inverse, size).tolist()
        assert own == [int(url_filter.substring_hashes(*url_filter.prefix_hashes(run[i : i + size]), size)[0]) for i in range(len(run) - size + 1)]
