"""Operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wordtide.llm import chat, components, exact_dedup, fingerprints, jaccard_join, line_dedup, mixing, packing, sharding, toxicity, url_filter

LONG = "long text of many words " * 4000
TEXTS = [
    (1, "Hello  wide\tworld"), (2, "Hello wide world"), (3, None), (4, ""), (5, LONG), (6, "a shared line here\nown line one\n"),
    (7, "  A SHARED line here\r\nown line two\nÀ short"), (7, "  A SHARED line here\r\nown line two\nÀ short"), (None, "a shared line here"), (9, "  "), (10, "x"), (11, LONG),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i == 4 else f"s{(i or 0) % 3}", "n", 1, "k") for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n string, wordtide_drop int, key string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_exact_dedup(docs, empty):
    got = rows(exact_dedup.exact_duplicates(docs), "doc_id", "keep_id", "group_size")
    want = {1: (1, 2), 2: (1, 2), 3: (3, 2), 4: (3, 2), 5: (5, 2), 6: (6, 1), 7: (7, 2), None: (None, 1), 9: (9, 1), 10: (10, 1), 11: (5, 2)}
    assert got == sorted(((i, *want[i]) for i, _ in TEXTS), key=str)
    assert exact_dedup.exact_duplicates(docs, support=0.15).count() == len(TEXTS)
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_heavy_hitters_are_verified(spark):
    digests = spark.createDataFrame([(i, "hot" if i % 3 == 0 else str(i)) for i in range(300)], "doc_id long, digest string")
    assert rows(exact_dedup.heavy_hitters(digests, 0.1), "digest", "group_size", "keep_id") == [("hot", 100, 0)]


@pytest.mark.parametrize("bound", [1 << 30, 0])
def test_line_dedup(docs, empty, bound):
    got = rows(line_dedup.drop_repeated_lines(docs, broadcast_bytes=bound), "doc_id", "wordtide_n_lines", "wordtide_n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256))
    known = [(line_dedup.NO_ID if i is None else i, t) for i, t in TEXTS]
    want = line_dedup.brute_force(known)
    assert got == sorted(((i, *want[k]) for (i, _), (k, _) in zip(TEXTS, known, strict=True)), key=str)
    assert line_dedup.drop_repeated_lines(empty, broadcast_bytes=bound).count() == 0


def test_minimal_hash():
    rng = np.random.default_rng(3)
    high, low = rng.integers(0, 1 << 63, (2, 5000)).astype(np.uint64)
    one = line_dedup.MinimalHash(high, low)
    assert sorted(one(high, low)) == list(range(5000))


def test_sharding(docs, empty):
    out = sharding.sharded(docs, 5).collect()
    slots: dict = {}
    for r in out:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 5)
    assert len(out) == len(TEXTS) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted(r["size"] for r in out if r["doc_id"] in (3, 4)) == [8, 8]
    assert sharding.sharded(empty, 5).count() == 0


def test_jump_hash_moves_only_into_the_new_shard(spark):
    keys = spark.range(4000).select("id", *(sharding.jump_hash(F.col("id"), n).alias(f"s{n}") for n in range(1, 9)))
    for r in keys.collect():
        assert r["s1"] == 0
        for n in range(1, 8):
            assert r[f"s{n + 1}"] in (r[f"s{n}"], n)
    sizes = [r["count"] for r in keys.groupBy("s8").count().collect()]
    assert len(sizes) == 8 and min(sizes) > 400 and max(sizes) < 600


def test_mixing_stays_within_a_block(spark, docs, empty):
    assert mixing.schedule(docs, {"s1": 2.0}, block_rows=2).count() == len(TEXTS)
    assert mixing.schedule(empty).count() == 0
    data = spark.range(600).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 6 < 3, "a").when(F.col("id") % 6 < 5, "b").otherwise("c").alias("source"))
    out = sorted((r["wordtide_slot"], r["wordtide_place"], r["source"]) for r in mixing.schedule(data, {"a": 3, "b": 2, "c": 1}, block_rows=5).collect())
    assert len(out) == 600 and len({x[:2] for x in out}) == 600
    blocks = [s for slot, place, s in out if place == 0]
    for source, share in (("a", 3 / 6), ("b", 2 / 6), ("c", 1 / 6)):
        n = 0
        for t, s in enumerate(blocks, 1):
            n += s == source
            assert abs(n - t * share) < 1.05  # a block, and the rounding of weights


@pytest.mark.parametrize("seed", range(6))
def test_periods_deviate_less_than_a_block(seed):
    rng = random.Random(seed)
    weights = {f"s{i}": rng.randint(1, 30) for i in range(rng.randint(1, 8))}
    total, slots = sum(weights.values()), mixing.period(weights)
    for k, w in weights.items():
        n = 0
        for t in range(total):
            n += t in slots[k]
            assert abs(n - (t + 1) * w / total) < 1


def slot_sources(blocks, weights):
    """The source of each slot, by the arithmetic of ``schedule`` in plain Python."""
    out = {}
    for k, parts in mixing.phases(blocks, weights).items():
        for first, end, start, total, slots in parts:
            for i in range(end - first):
                slot = start + i // len(slots) * total + slots[i % len(slots)]
                assert out.setdefault(slot, k) == k
    return [out[t] for t in range(len(out))]


UNEVEN = {f"s{i}": 1 + i % 7 for i in range(1500)}


@pytest.mark.parametrize(("weights", "blocks"), [
    ({f"src{i}": mixing.WEIGHTS.get(f"src{i}", 1.0) for i in range(20)}, lambda w, i: 500 * w),
    ({f"src{i}": mixing.WEIGHTS.get(f"src{i}", 1.0) for i in range(500)}, lambda w, i: 20 * w + i % 3),
    (UNEVEN, lambda w, i: 3 * w),
    ({"a": 0.1, "b": 0.3, None: 1 / 3, "c": 1e-5}, lambda w, i: 400 + 90 * i),
    ({f"s{i}": 1.0 for i in range(300)}, lambda w, i: 1 + i % 5),
])
def test_mixing_keeps_the_stated_weights(weights, blocks):
    left = {k: int(blocks(w, i)) for i, (k, w) in enumerate(weights.items())}
    dealt = slot_sources(left, weights)
    assert len(dealt) == sum(left.values())
    alive, since, sent = dict(weights), 0, dict.fromkeys(weights, 0)
    total = sum(alive.values())
    for t, k in enumerate(dealt, 1):
        sent[k] += 1
        left[k] -= 1
        step = t - since
        if step % 17 == 0 or not left[k]:
            assert all(abs(sent[x] - step * w / total) < 1 + 1e-9 for x, w in alive.items())
        assert abs(sent[k] - step * alive[k] / total) < 1 + 1e-9
        if not left[k]:  # a new phase
            del alive[k]
            since, sent, total = t, dict.fromkeys(alive, 0), sum(alive.values())
    assert not alive


def test_mixing_of_many_sources(spark):
    most = 6000
    own = F.when(F.col("id") < 3 * most, F.col("id") % most).otherwise(F.lit(most) + F.col("id") % 40)
    data = spark.range(5 * most).select(F.col("id").alias("doc_id"), F.when(own > 0, own.cast("string")).alias("source"))
    plan = mixing.lookup({str(i): 1 + i % 300 for i in range(most)}, {str(i): 1.0 + i % 5 for i in range(most)})
    assert sum(x.nbytes for x in plan[1:]) < 6 * 8 * sum(1 + i % 300 for i in range(most))
    out = mixing.schedule(data, {"7": 3.0}, block_rows=2).collect()
    assert {r["doc_id"] for r in out} == set(range(5 * most))
    held: dict = {}
    for r in out:
        held.setdefault(r["wordtide_slot"], []).append((r["wordtide_place"], r["source"]))
    assert sorted(held) == list(range(len(held)))
    assert all(len({k for _, k in x}) == 1 and sorted(p for p, _ in x) == list(range(len(x))) for x in held.values())
    few = {"a": 90, None: 30, "b": 7}
    table, want = mixing.lookup(few, dict.fromkeys(few, 1.5)), mixing.phases(few, dict.fromkeys(few, 1.5))
    names, blocks = [k for k, n in few.items() for _ in range(n)], [i for n in few.values() for i in range(n)]
    slots = mixing.slots_of(pa.array(names, pa.string()), pa.array(blocks), table).to_pylist()
    assert sorted(slots) == list(range(127))
    for k, parts in want.items():
        exact = [start + i // len(at) * span + at[i % len(at)] for first, end, start, span, at in parts for i in range(end - first)]
        assert [s for s, name in zip(slots, names, strict=True) if name == k] == exact


def best_fit(lengths, capacity):
    bins: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [(left, i) for i, left in enumerate(bins) if left >= n]
        if fits:
            bins[min(fits)[1]] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)


@pytest.mark.parametrize("seed", range(8))
def test_best_fit_decreasing_is_exact(seed):
    rng = random.Random(seed)
    capacity = rng.choice([9, 32, 100])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 150))]
    runs, n = packing.best_fit_decreasing({x: lengths.count(x) for x in lengths}, capacity)
    left, ends = [capacity] * n, {}
    for length, first, bin_, each, offset in sorted(runs, reverse=True):
        stop = ends.get(length, lengths.count(length))
        for i in range(first, stop):
            at = bin_ + (i - first) // each
            left[at] -= length
        ends[length] = first
    assert sorted(left) == best_fit(lengths, capacity)


def test_packing(docs, empty):
    out = packing.packed(docs, capacity=64).collect()
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(packing.vocabulary_path())
    ids = {i: [*known.encode(t or "", add_special_tokens=False).ids, 2] for i, t in TEXTS}
    bins: dict = {}
    for r in out:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"] and len(part) == r["length"]
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) == len(best_fit([r["length"] for r in out], 64))
    assert sum(r["length"] for r in out) == sum(len(ids[i]) for i, _ in TEXTS)
    assert packing.packed(empty).count() == 0


def test_encoder_gives_the_files_ids():
    from tokenizers import Tokenizer

    one, known = packing.ByteBpe(packing.vocabulary_path()), Tokenizer.from_file(packing.vocabulary_path())
    for t in ("", " a  b\n\n c ", "I'll «été» 123 日本\u00a0x", "a<|endoftext|>b", "tab\t\tx \n y", "🙂🙂 don't"):
        assert np.frombuffer(one.ids(t), "<u4").tolist() == known.encode(t, add_special_tokens=False).ids


def test_encoder_on_white_space_of_any_length():
    from tokenizers import Tokenizer

    one, known = packing.ByteBpe(packing.vocabulary_path()), Tokenizer.from_file(packing.vocabulary_path())
    for t in ("\n" * 2_000_000, "a" + " " * 1_000_000 + "b", "x " * 300_000, "a\u3000" * 60_000):
        assert np.frombuffer(one.ids(t), "<u4").tolist() == known.encode(t, add_special_tokens=False).ids


def test_a_text_of_newlines_is_packed(spark):
    rows = packing.packed(spark.createDataFrame([(1, "\n" * 2_000_000), (2, "short")], "doc_id long, text string")).collect()
    whole = sum(r["length"] for r in rows if r["doc_id"] == 1)
    assert whole == len(np.frombuffer(packing.ByteBpe(packing.vocabulary_path()).ids("\n" * 2_000_000), "<u4")) + 1 and max(r["length"] for r in rows) <= 1024


def shingles(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute_components(data):
    sets, label = [shingles(t) for _, t in data], {i: i for i, _ in data}
    changed = True
    links = [(a, b) for x, (a, _) in enumerate(data) for y, (b, _) in enumerate(data) if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y])]
    while changed:
        changed = False
        for a, b in links:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return {(i, len(s), label[i]) for (i, _), s in zip(data, sets, strict=True)}


def test_jaccard_join_against_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [[word() for _ in range(rng.choice([3, 8, 30, 60]))] for _ in range(12)]
    passage = [word() for _ in range(25)]
    data = [(0, None), (1, ""), (2, "one two"), (3, "ONE\ttwo"), (4, "x")]
    for i in range(5, 130):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            words[rng.randrange(len(words))] = word()
        if rng.random() < 0.3:
            words += passage
        data.append((i, " ".join(words)))
    df = spark.createDataFrame([(i, t, "x") for i, t in data], "doc_id long, text string, component string").repartition(7)
    monkeypatch.setattr(jaccard_join, "LEAF", 4)  # so that cells take new pivots
    monkeypatch.setattr(jaccard_join, "FLAT_LEAF", 6)
    monkeypatch.setattr(jaccard_join, "HELD", 10)
    got = {tuple(r) for r in jaccard_join.linked_components(df).collect()}
    assert got == brute_components(data)


def test_jaccard_join_small(docs, empty):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.linked_components(docs).collect()}
    assert got[1] == (1, 1) and got[2] == (1, 1) and got[3] == (0, 3) and got[9] == (0, 9) and got[11][1] == 5 and got[None][1] is None
    assert jaccard_join.linked_components(empty).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(20, 60)] + [(5, 5)]
    got = dict(rows(components.components(spark.createDataFrame(links, "a long, b long")), "node", "component"))
    assert all(got[i] == 100 for i in range(100, 141)) and all(got[i] == 7 for i in range(20, 60)) and len(got) == 82


def test_fingerprints(docs, empty):
    got = [r["fingerprint"] for r in fingerprints.fingerprints(docs).orderBy("doc_id", "fingerprint").collect()]
    assert len(got) == len(TEXTS) and all(len(x) == 2 * fingerprints.SLOTS for x in got)
    assert fingerprints.fingerprints(empty).count() == 0


def test_equal_substrings_share_signatures():
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefghij ") for _ in range(4000))
    other = "".join(rng.choice("abcdefghij ") for _ in range(4000))
    made = fingerprints.fingerprint_texts(fingerprints.Parser(), [x.encode() for x in (text, "shift" + text, text[:3000] + other[:1000], other, text)])
    like = lambda a, b: float(fingerprints.likeness(made[a : a + 1], made[b : b + 1])[0])
    assert like(0, 4) == 1 and like(0, 1) > 0.9 and 0.4 < like(0, 2) < 0.8 and like(0, 3) < 0.1


def test_op2_follows_the_order_of_ids(spark, tmp_path):
    data = [(i * 7 % 50, "".join(random.Random(i).choice("abc é\n") for _ in range(i % 9 * 5))) for i in range(50)]
    spark.createDataFrame(data, "doc_id long, text string").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in fingerprints.op2_document_fingerprints(spark, str(tmp_path)).collect()}
    texts = dict(data)
    for i in range(50):
        t, n = texts[i], texts[(i + 1) % 50]
        q = len(t) // 4
        assert got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - q] + n[:q]).encode()).hexdigest() and got[i]["n_chars"] == len(t)
        assert (got[i]["near_edited"] == 1) or q > 0


def test_forward_backward_against_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    odds, step, init = np.exp(rng.normal(size=9)), np.exp(rng.normal(size=(2, 2))), np.exp(rng.normal(size=2))
    first = np.array([1, 0, 0, 0, 1, 0, 0, 0, 0], bool)
    a, b = toxicity.forward_backward(odds, first, step, init)
    p = (a * b)[:, 1] / (a * b).sum(1)
    for s, e in ((0, 4), (4, 9)):
        total, sums = 0.0, np.zeros(e - s)
        for tags in itertools.product((0, 1), repeat=e - s):
            w = init[tags[0]]
            for i, t in enumerate(tags):
                w *= (odds[s + i] if t else 1) * (step[tags[i - 1], t] if i else 1)
            total, sums = total + w, sums + w * np.array(tags)
        assert np.allclose(sums / total, p[s:e])


def test_toxicity(spark, docs, empty):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    data, labels = [], []
    for i in range(400):
        words = [word() for _ in range(30)]
        if i % 4 == 0:
            words.insert(rng.randrange(30), rng.choice(["Vileword", "vileworm"]))
        data.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    df = spark.createDataFrame(data, "doc_id long, text string")
    field = toxicity.fit(df, spark.createDataFrame([*labels, (900, None), (None, 1)], "doc_id long, toxic int"))
    out = {r["doc_id"]: r for r in toxicity.scored(df, field).collect()}
    assert sum((out[i]["score"] >= toxicity.CUT) == bool(t) for i, t in labels) >= 396
    span = out[0]["spans"][0]
    assert data[0][1][span["start"] : span["end"]].lower().startswith("vilewor")
    assert toxicity.without_toxic(docs, field).count() == len(TEXTS) and toxicity.scored(empty, field).count() == 0
    assert {r["score"] for r in toxicity.scored(docs, field).where("doc_id in (3, 4, 9)").collect()} == {0.0}
    none = toxicity.fit(df, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    assert toxicity.scored(df, none).where(F.col("score") >= 0.5).count() == 0


def test_chat(spark):
    nasty = "\\<|user|>\n[INST]\\\\</s>\n<s>|> [/INST]<"
    assert chat.unescaped(chat.escaped(nasty)) == nasty and chat.turns_of(f"<|{chat.escaped(nasty)}|>\n{chat.escaped(nasty)}</s>\n") == [(nasty, nasty)]
    data = [(1, 0, "system", nasty), (1, 1, "user", None), (1, 2, "assistant", "A " + nasty), (1, 3, "assistant", "B"), (1, 4, "user", "end"), (2, 0, "user", "only"), (None, 0, None, "x"), (3, None, "assistant", "y")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    made = chat.examples(df).collect()
    assert sorted((str(r["conv_id"]), r["example"]) for r in made) == [("1", 0), ("1", 1), ("1", 2), ("2", 0), ("3", 0), ("None", 0)]
    got = {r["conv_id"]: r for r in chat.read_back(chat.examples(df)).collect()}
    loss = "A " + nasty + "B"
    assert got[1]["n_turns"] == 5 and got[1]["loss_chars"] == len(loss) and got[1]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert got[2]["loss_chars"] == 0 and got[None]["turns_sha256"] == hashlib.sha256(b"\nx\n").hexdigest()
    assert chat.read_back(chat.examples(df.where("false"))).count() == 0


def test_url_filter(spark):
    data = [
        (1, "https://WWW.Example.com/en/1?x", "<p>good day</p>"), (2, "http://a.example.com/en/2", None), (3, "http://x.com/fr", ""), (4, "http://x.net/es/", ""), (5, "http://xcom/", ""), (6, None, ""), (7, "no scheme", ""),
        (8, "http://goodday.org/fr/3#f", "<script>bad</script>good day day"), (8, "http://goodday.org/fr/3#f", ""), (9, "http://b.net?q=/es/", ""), (10, "ftp://é.org/" + "a" * 400, ""),
    ]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    got = {r["page_id"]: tuple(r)[1:5] for r in url_filter.judged(df).collect()}
    assert got[1] == ("www.example.com", "/en/1", "www.example.com/en/", "allow") and got[2][2:] == ("example.com/en/", "block")
    assert got[3][2:] == ("com/", "allow") and got[4][2:] == ("net/es/", "block") and got[5][2] is None and got[6][:3] == ("", "", None) and got[7][:2] == ("", "")
    assert got[9][:3] == ("b.net", "", None) and all(v[3] in ("allow", "block") for v in got.values())
    assert url_filter.judged(df.where("false")).count() == 0
    words = url_filter.viterbi("goodday", [(0, 4, 5), (4, 3, 9)], 20.0)
    assert words == ["good", "day"]
    split = {r["token"]: r["words"] for r in url_filter.segmented(spark.createDataFrame([("goodday",), ("a" * 400,)], "token string"), url_filter.word_counts(df)).collect()}
    assert split == {"goodday": ["good", "day"], "a" * 400: ["a" * 400]}


def test_naive_bayes_follows_the_ruled_urls(spark):
    data = [(i, f"http://s{i}.com/tea/{i}", "") for i in range(20)] + [(100 + i, f"http://s{i}.net/es/spam/{i}", "") for i in range(20)] + [(500, "http://x.org/tea/1", ""), (501, "http://x.org/spam/1", "")]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judged(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert got[500] == "allow" and got[501] == "block"


def test_utf8_of_sliced_columns():
    from wordtide.llm import shared

    column = pa.array(["ab", None, "é", ""])[1:]
    data, offsets = shared.utf8(column)
    assert bytes(data) == "é".encode() and offsets.tolist() == [0, 0, 2, 2]


def test_large_cells_are_parted_into_regions_or_stay_flat(spark):
    """A cell of two tight groups far apart is split, and a point between them stands in both regions; one of scattered points is not."""
    place = {1: 0.0, 2: 0.02, 3: 0.05, 4: 0.9, 5: 0.92, 6: 0.97, 7: 0.1}  # on a line, so that distances keep the triangle inequality
    rows = [("tight", p, s, abs(place[p] - place[s])) for p in place for s in (1, 4)]
    rows += [("tight", 8, s, d) for s, d in ((1, 0.5), (4, 0.4))]
    rows += [("loose", p, s, 0.6 + 0.01 * p) for p in range(10, 20) for s in (30, 31, 32)]
    measured = spark.createDataFrame(rows, "name string, point long, sub long, distance double").select(
        F.xxhash64("name").alias("cell"), F.lit(0).cast("long").alias("pivot"), "point", F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("left"), F.lit(b"").alias("bits"), "distance", F.lit(False).alias("flat"), F.lit(1).alias("visit"), "sub"
    )
    out = jaccard_join.voronoi(measured, None, 75).collect()
    regions = collections.defaultdict(set)
    for r in out:
        regions[r["pivot"], r["flat"]].add(r["point"])
    assert regions[1, False] == {1, 2, 3, 7, 8} and regions[4, False] == {4, 5, 6, 8}
    assert regions[30, True] == set(range(10, 20)) and len(regions) == 3


def test_jaccard_cell_of_scattered_points_stays_flat(spark, monkeypatch):
    """One text in sixty versions of which few are linked: the cell's windows reach everywhere, and its flat rounds find all links."""
    rng = random.Random(11)
    monkeypatch.setattr(jaccard_join, "LEAF", 4)
    monkeypatch.setattr(jaccard_join, "FLAT_LEAF", 6)
    flat = []

    def counted(measured, sizes, threshold, own=jaccard_join.voronoi):
        out = own(measured, sizes, threshold)
        flat.append(out.where("flat").count())
        return out

    monkeypatch.setattr(jaccard_join, "voronoi", counted)
    data = []
    for i in range(60):
        words = [f"w{k}" for k in range(100)]
        for at in rng.sample(range(100), rng.choice([1, 2, 2, 3])):
            words[at] = f"own{rng.randrange(8)}"
        data.append((i, " ".join(words)))
    got = {tuple(r) for r in jaccard_join.linked_components(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == brute_components(data) and flat and max(flat) > 0


def test_jaccard_signatures_grow_with_their_sets():
    rng = np.random.default_rng(0)
    drawn = lambda n: np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
    sets = [drawn(n) for n in (3, 1024, 1025, 2500, 3000, 6000)]
    sets += [np.unique(np.append(s[len(s) // 20 :], drawn(len(s) // 20))) for s in sets]
    told = jaccard_join.Signatures(pa.array([jaccard_join.signature(s) for s in sets], pa.binary()))
    x, y = np.nonzero(np.ones((len(sets), len(sets)), bool))
    apart = told.taken(x).apart(told.taken(y), np.arange(len(x)))
    assert all(d <= len(np.setxor1d(sets[i], sets[j])) for i, j, d in zip(x, y, apart, strict=True))  # a lower bound, whatever the lengths
    n, none = np.array([len(s) for s in sets]), np.full(len(sets), np.nan)
    rows = [n, n, np.arange(len(sets)), none]
    found, _ = jaccard_join.near_enough([v[x] for v in rows] + [told.taken(x)], [v[y] for v in rows] + [told.taken(y)], 75)
    found = set(zip(x[found].tolist(), y[found].tolist(), strict=True))
    assert {(i, i + 6) for i in range(6)} <= found and not {(3, 4), (4, 3), (3, 10), (9, 4)} & found  # long sets without a common shingle are told apart
