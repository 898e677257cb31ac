"""Small-table tests of the text operators against brute force: nulls, empty and very long texts, ties, repeated rows, empty tables,
extra columns."""

import base64
import hashlib
import math
import random
import re

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from voxelweave.llm import byte_bpe, decontaminate, html_extract, jaccard_join, language_id, quality, suffix_dedup, token_counts, top_k, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, hits string, _n long"
RANKS, JSON = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")


def rows(texts):
    return [(i, t, "en", "s", None if t is None else len(t), "x", 7) for i, t in texts]


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus():
    rng = random.Random(3)
    base = words(rng, 120, 5000)
    near = base.split()
    near[5] = "changed"
    out = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One"), (6, base), (7, base), (7, base), (8, " ".join(near)), (9, "aa " * 3000), (10, "é日本" * 200), (None, base.upper()), (11, "x\0y\0" * 80)]
    out += [(20 + i, words(rng, rng.randrange(1, 200))) for i in range(30)]
    shared = words(rng, 60, 5000)
    out += [(60 + i, words(rng, 30) + " " + shared + " " + words(rng, 30)) for i in range(8)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(corpus()), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_bpe_equals_tiktoken_and_decodes_back(docs, none):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(RANKS, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = byte_bpe.decode(byte_bpe.encode(docs, RANKS, P.PATTERN).drop("hits"), RANKS, P.PATTERN).select("doc_id", "ids", "decoded", "_n").collect()
    got = sorted((r.doc_id or -1, list(r.ids), bytes(r.decoded)) for r in out)
    assert got == sorted((i or -1, own.encode_ordinary(t or ""), (t or "").encode()) for i, t in corpus())
    assert byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(none, RANKS, P.PATTERN), RANKS, P.PATTERN)).count() == 0


def test_token_counts_equal_the_library(docs, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(JSON)
    size = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    got = sorted((r.doc_id or -1, r.n_tokens) for r in token_counts.count_tokens(docs, JSON).collect())
    assert got == sorted((i or -1, size(t or "")) for i, t in corpus())
    assert token_counts.count_tokens(none, JSON).count() == 0
    counter = token_counts.PrefixCounter(JSON)
    for text in ("don't  stop", "a<|endoftext|>b <|endoftext|>", "ab12" * 50, "   x", "日本語 ՘ text", "internationalisation"):
        assert counter.count(text) == size(text)
        ends, counts = counter.boundaries(text)
        assert [size(text[:e]) for e in ends] == counts
        for budget in range(6):
            n = counter.fit(text, budget)
            assert size(text[:n]) <= budget
        assert list(counter.prefix_counts(text.split("<")[0].encode()))[0] == 0
    word = "internationalisation"
    assert list(counter.prefix_counts(word.encode())) == [size(word[:i]) for i in range(len(word) + 1)]


def test_repeats_equal_brute_force(docs, none):
    def expected(texts, n):
        seen, out = set(), {}
        for i, t in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0)):
            b = (t or "").encode()
            if (i, b) in out:
                continue
            gone = bytearray(len(b))
            for s in range(len(b) - n + 1):
                if b[s : s + n] in seen:
                    gone[s : s + n] = b"\x01" * n
                seen.add(b[s : s + n])
            kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
            out[i, b] = (len(b), len(b) - len(kept), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())
        return sorted((i or -1, *out[i, (t or "").encode()]) for i, t in texts)

    got = suffix_dedup.remove_repeats(docs, 100)
    assert sorted((r[0] or -1, *r[1:]) for r in got.collect()) == expected(corpus(), 100)
    whole = suffix_dedup.remove_repeats(docs, 100, whole=True, carry=["lang", "hits"])
    assert set(whole.columns) == {"doc_id", "spans", "kept", "kept_text", "lang", "hits"}
    assert {len(r.kept) for r in whole.where("doc_id = 7").collect()} == {0}
    assert suffix_dedup.remove_repeats(none, 100).count() == 0


def test_repeats_of_any_length(spark):
    rng = random.Random(12)
    passages = [words(rng, 200, 4000) for _ in range(3)]
    texts = {i: f"{words(rng, 30, 4000)} {passages[i % 3][i * 7 :]} {words(rng, 60, 4000)}" for i in range(9)} | {20: "short"}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for n in (1, 12, 39, 400, 700):
        seen, expect = set(), {}
        for i, t in texts.items():
            b = t.encode()
            gone = bytearray(len(b))
            for s in range(len(b) - n + 1):
                if b[s : s + n] in seen:
                    gone[s : s + n] = b"\x01" * n
                seen.add(b[s : s + n])
            expect[i] = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(frame, n, whole=True).collect()}
        assert got == expect, n
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(frame, 0)


def brute_kept(texts, n):
    """Kept bytes by id of {id: text}."""
    seen, out = set(), {}
    for i, t in sorted(texts.items()):
        b = t.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - n + 1):
            if b[s : s + n] in seen:
                gone[s : s + n] = b"\x01" * n
            seen.add(b[s : s + n])
        out[i] = bytes(x for x, g in zip(b, gone, strict=True) if not g)
    return out


def test_repeats_of_hot_anchors_long_texts_and_small_batches(spark, monkeypatch):
    rng = random.Random(13)
    phrase, passage = words(rng, 12, 4000)[:55], words(rng, 60, 4000)
    texts = {i: f"{words(rng, 20, 4000)} {phrase} {words(rng, 25, 4000)} {passage if i % 3 else ''}" for i in range(60)}  # every text has the phrase, most the passage
    texts[70] = " ".join([words(rng, 130_000, 90_000), passage, words(rng, 5000, 90_000)])  # longer than a slice
    texts[71] = texts[70][300_000:620_000] + "\0\0" + texts[70][:2000]
    texts[72] = "ab\0" * 400
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    want = brute_kept(texts, 100)
    assert len(texts[70]) > suffix_dedup.SLICE and all(len(want[i]) < len(texts[i]) for i in (70, 71, 72))
    for limits in ({}, {"HOT_LEAST": 20, "HOT": 1 << 40}, {"HOT_LEAST": 0, "HOT": 1 << 40}, {"FLUSH": 50, "CUT": 3000, "BATCH": 64, "FAMILY": 100, "HOT_LEAST": 30, "HOT": 1 << 40}):
        with monkeypatch.context() as m:
            for k, v in limits.items():
                m.setattr(suffix_dedup, k, v)
            got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(frame, 100, whole=True).collect()}
        assert got == want, limits


def test_suffix_levels_merge_geometrically():
    import numpy as np

    family = suffix_dedup.SuffixLevels(4)
    for k in range(8):
        data = np.frombuffer(f"k{k:03d}zz".encode(), np.uint8)
        assert not family.add(data, np.arange(3))[:1].any()
    assert [x is not None for x in family.levels] == [False, False, False, True]
    assert family.add(np.frombuffer(b"k005", np.uint8), np.arange(1)).tolist() == [True]


def brute_components(texts, width=5, percent=75):
    sets = []
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((i, frozenset(tuple(w[j : j + width]) for j in range(max(1, len(w) - width + 1))) if w else frozenset()))
    part = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                part = [part[b] if p == part[a] else p for p in part]
    least = {}
    for (i, _), p in zip(sets, part, strict=True):
        if i is not None:
            least[p] = min(least.get(p, i), i)
    return sorted(((-1 if i is None else i), len(s), least.get(p, -1) if s else (-1 if i is None else i)) for (i, s), p in zip(sets, part, strict=True))


def test_jaccard_join_equals_brute_force(docs, none):
    got = jaccard_join.join_components(docs)
    assert sorted((-1 if r[0] is None else r[0], r[1], -1 if r[2] is None else r[2]) for r in got.collect()) == brute_components(corpus())
    assert jaccard_join.join_components(none).count() == 0


def test_sets_that_take_one_id_stay_apart(spark):
    rng = random.Random(15)
    texts = [(i, words(rng, rng.randrange(1, 40), 3000)) for i in range(120)]
    texts += [(200 + i, texts[i][1]) for i in range(20)] + [(300, "z" * 4000 + " a b c d"), (301, "z" * 4001 + " a b c d")]
    frame = spark.createDataFrame(rows(texts), DOCS)
    assert sorted(map(tuple, jaccard_join.join_components(frame, bits=5).collect())) == brute_components(texts)


def test_jaccard_join_of_frequent_tokens_and_blocks(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for i in range(80):  # one group of near copies, whose tokens are all frequent
        w = list(base)
        for _ in range(rng.randrange(0, 7)):
            w[rng.randrange(len(w))] = f"u{rng.random()}"
        texts.append((i, " ".join(w)))
    texts += [(100 + i, " ".join(base[: 4 + i])) for i in range(40)]
    frame = spark.createDataFrame(rows(texts), DOCS)
    assert sorted(map(tuple, jaccard_join.join_components(frame).collect())) == brute_components(texts)
    index = jaccard_join.indexed(jaccard_join.shared_tokens(jaccard_join.postings(frame, 5, 64), 64), 64, 75, frequent=3)
    index = index.cache()
    roots = jaccard_join.components(jaccard_join.candidate_edges(index, 75))
    whole = jaccard_join.components(jaccard_join.verified(index, roots, 75))
    cut = jaccard_join.components(jaccard_join.verified(index, roots, 75, block=7))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, cut.collect()))
    feats = {r.doc_id: r.cls for r in jaccard_join.classes(frame, 5).collect()}
    named = {r.node: r.root for r in whole.collect()}
    expect = {i: c for i, _, c in brute_components(texts)}
    mine = {}
    for i, c in feats.items():
        mine.setdefault(named.get(c, c), []).append(i)
    assert all(expect[i] == min(ids) for ids in mine.values() for i in ids)


def test_decontamination_equals_brute_force(spark, docs, none):
    rng = random.Random(9)
    texts = dict(corpus())
    long = " ".join(texts[60].split()[20:60])
    items = [(1, long), (2, "One"), (3, None), (4, " .,; "), (5, words(rng, 20)), (2, "w1 w2"), (None, "aa aa"), (7, long)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    pick = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = {}
    for i, t in items:
        w = pick(t)
        for j in range(max(1, len(w) - 12) if w else 0):
            wins.setdefault(tuple(w[j : j + 13]), set()).add("null" if i is None else str(i))
    expect = []
    for i, t in corpus():
        w, hit, ids = pick(t), set(), set()
        for win, own in wins.items():
            for j in range(len(w) - len(win) + 1):
                if tuple(w[j : j + len(win)]) == win:
                    hit |= set(range(j, j + len(win)))
                    ids |= own
        expect.append((i or -1, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    for block in (1 << 24, 40):  # one automaton, or one for every few windows
        got = decontaminate.with_verdict(decontaminate.find_hits(docs.select("doc_id", "text"), bench, block=block))
        assert sorted((r[0] or -1, *r[1:]) for r in got.collect()) == sorted(expect)
    spans = decontaminate.find_hits(docs.where("doc_id = 60"), bench, keep_text=True).first()
    assert spans.text.encode()[spans.hits[0].start_byte : spans.hits[0].end_byte].decode().split()[0] in long
    assert decontaminate.with_verdict(decontaminate.find_hits(none, bench)).count() == 0
    assert decontaminate.with_verdict(decontaminate.find_hits(docs, bench.limit(0))).where("contaminated OR n_hit > 0").count() == 0


def test_language_id(spark, none):
    rng = random.Random(2)
    lexicon = {s: ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(3, 9))) for _ in range(80)] for s in ("aa", "bb")}
    make = lambda s: " ".join(rng.choice(lexicon[s]) for _ in range(60))
    texts = [(i, make(s), s) for i in range(240) for s in [("aa", "bb")[i % 2]]]
    frame = spark.createDataFrame([*texts, (900, None, "aa"), (901, "12 !?", "bb"), (None, make("aa"), None)], "doc_id long, text string, lang string")
    frame = frame.withColumn("held_out", language_id.held_out())
    found = language_id.predict(frame, language_id.fit(frame.where("NOT held_out")), min_margin=0.01).toPandas()
    held = found[found.held_out & found.doc_id.lt(900)]
    assert (held.lang == held.lang_pred).mean() > 0.95
    assert set(found[found.doc_id.isin([900, 901])].lang_pred) == {"und"} and found.score.between(0, 1).all()
    assert language_id.fit(none) == {} and language_id.predict(frame, {}).where("lang_pred <> 'und'").count() == 0


def test_letters_and_marks():
    assert not language_id.has_letter("\u00bd \u00b2 12 \u2167 !?") and language_id.has_letter("12 \u0915") and language_id.has_letter("\u00aa")
    model = language_id.Classifier({"aa": b"some words of it " * 20, "bb": b"other things here " * 20}, 3)
    assert model.predict("\u00bd \u00b2 12") == ("und", 0.0, 0.0) and model.predict(None)[0] == "und" == model.predict("")[0]
    assert language_id.plain("Ne\u0301e, \u0939\u093f\u0928!2") == "ne\u0301e \u0939\u093f\u0928 " and language_id.plain("\u00c9T\u00c9\u00b2x") == "\u00e9t\u00e9 x "
    both = model.predict("some words of it " * 400)
    assert both[0] == "aa" and 0 <= both[1] <= 1 and both[2] > 0


def test_language_rows(spark):
    frame = spark.createDataFrame([(1, "some words", "aa", 1.0, "x"), (1, "some words", "aa", 2.0, "y"), (None, "word", "bb", 3.0, "z"), (2, "word", None, None, None)], "doc_id long, text string, lang string, score double, lang_pred string")
    model = language_id.fit(frame)
    assert set(model) == {"aa", "bb"} and model == language_id.fit(frame.repartition(3))
    out = language_id.predict(frame, model)
    assert out.columns.count("score") == out.columns.count("lang_pred") == 1 and out.count() == 4
    tie = language_id.predict(frame, {"b": b"same same same", "a": b"same same same"}).first()
    assert tie.lang_pred == "b"  # the order of the dictionaries, which fit() gives by labelled texts, then name


def test_clashing_names(spark):
    frame = spark.createDataFrame([(1, "a b c", 7, "own", 5)], "doc_id long, text string, n_bytes long, over_limit string, n_hit long")
    out = token_counts.with_lengths(token_counts.count_tokens(frame, JSON), 512)
    assert sorted(out.columns) == ["doc_id", "n_bytes", "n_hit", "n_tokens", "over_limit"] and out.first().n_bytes == 5
    clash = frame.withColumns({c: F.lit("own") for c in ("n_tokens", "ids_sha256", "ids", "decoded")})
    done = byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(clash, RANKS, P.PATTERN), RANKS, P.PATTERN))
    assert len(done.columns) == len(set(done.columns)) and done.first().n_tokens > 0
    clash = frame.withColumns({c: F.lit("own") for c in ("hits", "items", "n_items", "items_sha256", "contaminated", "n_words")})
    got = decontaminate.with_verdict(decontaminate.find_hits(clash, spark.createDataFrame([(1, "b c")], "item_id long, text string")))
    assert len(got.columns) == len(set(got.columns)) and got.first().n_hit == 2
    pages = spark.createDataFrame([(1, "u", "x", "own", 3)], "page_id long, url string, html string, payload_digest string, length long")
    assert warc.read_records(warc.write_archives(pages)).first().payload_bytes == 1


def test_lookups_of_hot_and_other_keys(spark):
    from voxelweave.llm.common import lookup

    left = spark.createDataFrame([(i, i % 7 if i % 2 else 3) for i in range(400)] + [(900, None), (901, 99)], "id long, k long")
    right = left.where("k < 6").groupBy("k").agg(F.count("*").alias("_n")).withColumn("v", F.col("k") * 10).withColumnRenamed("k", "key")
    want = sorted((i, k, None if k is None or k >= 6 else 10 * k) for i, k in map(tuple, left.collect()))
    order = lambda r: (r[0], r[1] or -1, r[2] or -1)
    for share in (1, 4, 10**6):  # all shuffled, the hot key by broadcast, all by broadcast
        assert sorted((tuple(r) for r in lookup(left, right, "k", "key", 402, share).collect()), key=order) == sorted(want, key=order)
    pages = spark.createDataFrame([(i, f"u{i}", "same" if i % 3 else f"t{i % 5}") for i in range(60)], "page_id long, url string, html string")
    found = [sorted(map(tuple, warc.with_originals(pages, share=s).select("page_id", "first_id").collect())) for s in (1, 2, 10**6)]
    assert found[0] == found[1] == found[2] and dict(found[0])[2] == 1


def test_a_payload_that_differs_from_its_digest_is_no_record():
    raw = warc.record(1, "u", b"payload", warc.base32_sha1(b"payload"), None, "1970-01-01T00:00:00Z")
    assert warc.checked(warc.parse(raw)) == (warc.base32_sha1(b"payload"), 7)
    with pytest.raises(ValueError):
        warc.checked(warc.parse(raw.replace(b"payload", b"paylaod")))


def test_budgets_equal_a_scan_of_prefixes(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(JSON)
    size = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    counter = token_counts.PrefixCounter(JSON)
    for text in ("internationalisation of words", "it's 'llama'", "\u65e5\u672c\u8a9e and   spaces", "x" * 300, "\u00e9" * 40):
        ends, counts = counter.boundaries(text)
        for budget in range(0, size(text) + 2):
            k = max(i for i, c in enumerate(counts) if c <= budget)
            last = ends[min(k + 1, len(ends) - 1)]
            best = max((n for n in range(ends[k], last + 1) if size(text[:n]) <= budget and (n < last or k + 1 == len(ends) or n == ends[k])), default=ends[k])
            assert counter.fit(text, budget) == (len(text) if k + 1 == len(ends) else best), (text, budget)
    frame = spark.createDataFrame([(1, "internationalisation of words"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.kept_chars for r in token_counts.truncate_to_budget(frame, JSON, 1).collect()} == {1: counter.fit("internationalisation of words", 1), 2: 0}
    rows = {r.doc_id: [tuple(x) for x in r.prefix_tokens] for r in token_counts.prefix_table(frame, JSON).collect()}
    assert rows[1] == list(zip(*counter.boundaries("internationalisation of words"), strict=True)) and rows[2] == [(0, 0)]


def test_runs_of_hit_words():
    assert decontaminate.joined([(0, 2), (1, 3), (5, 6), (3, 7), (9, 10)]) == [(0, 7), (9, 10)]
    import ahocorasick

    automaton = ahocorasick.Automaton()
    automaton.add_word(" aa aa ", (2, 7, ("1", "2")))
    automaton.make_automaton()
    n, runs, items = decontaminate.scan("aa " * 200_000, automaton)
    assert (n, runs, items) == (200_000, [(0, 200_000, 0, 599_999)], {"1", "2"})


def test_quality(spark, none):
    rng = random.Random(4)
    def make(kind):
        w = words(rng, rng.randint(40, 120), 900).split()
        if kind == "junk":
            w = [x + rng.choice(["%%%", "###"]) for x in w]
        if kind == "toxic":
            w[3] = w[9] = "idiot"
        return " ".join(w)
    kinds = ["clean"] * 6 + ["junk"] * 2 + ["toxic"] * 2
    texts = [(i, make(kinds[i % 10])) for i in range(600)] + [(700, None), (701, ""), (701, "")]
    frame = spark.createDataFrame(texts, "doc_id long, text string").withColumn("keep", F.lit("own"))
    marks = [(i, int(kinds[i % 10] != "junk"), int(kinds[i % 10] == "toxic")) for i in range(0, 600, 3)] + [(None, 1, 0), (5000, None, None), (0, None, 1)]
    model = quality.fit(frame, spark.createDataFrame(marks[:-1], "doc_id long, quality int, toxic int"))
    out = {r.doc_id: r.keep for r in quality.judge(frame, model).collect()}
    right = [out[i] == (kinds[i % 10] == "clean") for i in range(600)]
    assert sum(right) / len(right) > 0.97 and not out[700] and not out[701]
    again = quality.fit(frame.repartition(5), spark.createDataFrame(marks[:-1], "doc_id long, quality int, toxic int"))
    assert (again["quality"][0] == model["quality"][0]).all() and (again["toxic"][0] == model["toxic"][0]).all()
    rates = dict(zip(model["accuracies"]["labellers"], model["accuracies"]["quality"].transpose(1, 0, 2), strict=True))
    assert rates["symbols"][1][1] > 0.9 > 0.1 > rates["symbols"][0][1]  # says bad of bad texts, and not of good ones
    assert rates["rating"][1][1] > 5 * rates["rating"][0][1]
    blind = quality.fit(frame, None)
    assert {r.keep for r in quality.judge(frame.where("doc_id IN (6, 7)"), blind).collect()} == {False}
    assert quality.judge(none, quality.fit(none, None)).count() == 0
    q, rates, share = quality.em(quality.np.array([[1, 1, -1], [0, 0, 0], [1, 1, 1], [0, 0, -1]]))
    assert (q > 0.5).tolist() == [True, False, True, False] and 0.2 < share < 0.8 and rates.shape == (2, 3, 3)


def test_warc_round_trip(spark):
    pages = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (2, "http://a/2", "same"), (3, None, None), (4, "http://a/ 4\n", ""), (5, "u", "é" * 5000), (None, "n", "same"), (6, "x", "a\r\n\r\nWARC/1.0\r\n")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    index = warc.write_archives(frame)
    got = warc.read_records(index).collect()
    expect = []
    for i, _, h in pages:
        b = (h or "").encode()
        first = min((j for j, _, g in pages if (g or "") == (h or "") and j is not None), default=None)
        expect.append((i or -1, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first == i else "revisit", -1 if first == i else first))
    assert sorted((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or -1) for r in got) == sorted(expect)
    assert all(r.payload is None or base64.b32encode(hashlib.sha1(r.payload).digest()).decode() == r.payload_digest for r in got)
    some = warc.read_records(index.where("url = 'u'")).collect()
    assert [bytes(r.payload).decode() for r in some] == ["é" * 5000]
    assert warc.read_records(warc.write_archives(frame.limit(0))).count() == 0
    assert [x[1:3] for x in warc.coalesced([("a", 0, 5, 1), ("a", 7, 5, 2), ("a", 99, 1, 3), ("b", 0, 1, 4)], 10, 100)] == [(0, 12), (99, 100), (0, 1)]


def brute_top_k(vectors, k=5, scale=256, kind="float"):
    import numpy as np

    as_read = (lambda x: float(np.float32(x))) if kind == "float" else float
    ok = [(n, i, [math.floor(scale * as_read(x)) for x in v]) for n, (i, v) in enumerate(vectors) if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, _, v in ok), default=0)
    ok = [(n, i, v + [0] * (width - len(v))) for n, i, v in ok]
    out = []
    for n, i, v in ok:
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for m, j, w in ok if m != n)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def test_top_k_equals_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in rng.normal(size=8).round(2)]) for i in range(300)]
    vectors += [(300 + i, vectors[7][1]) for i in range(40)]
    vectors += [(400, None), (450, [None] * 8), (500, [float("nan")] * 8), (550, [1.0]), (600, []), (650, [0.0] * 8), (None, [1.0] * 8)]
    vectors += [(50, [0.5] * 8), (100, vectors[100][1]), (3, vectors[4][1]), (3, vectors[4][1])]  # repeated ids, of queries and of others
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumns({c: F.lit("own") for c in ("row", "block", "score", "rank", "query_id")}).repartition(3)
    for block in (2048, 16):
        got = top_k.top_k(frame, F.col("vec_id") % 50 == 0, block=block)
        assert sorted(map(tuple, got.collect())) == brute_top_k(vectors) and got.columns == ["query_id", "rank", "vec_id", "score"]
    few = top_k.top_k(frame.where("vec_id IN (0, 1, 2)"), F.col("vec_id") % 50 == 0)
    assert few.count() == 2
    assert top_k.top_k(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert top_k.top_k(frame, F.lit(False)).count() == 0


def test_top_k_of_long_vectors(spark):
    vectors = [(50 * i, [1e15 * (i % 4 - 1.5), 3.0 * i, -7.5e14]) for i in range(5)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        top_k.top_k(frame, F.col("vec_id") % 50 == 0, scale=1).collect()
    vectors = [(50 * i, [1e8 * (i % 4 - 1.5) + i, 3e8 + i, -7.5]) for i in range(5)]  # products beyond 2**53, sums within 64 bits
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, top_k.top_k(frame, F.col("vec_id") % 50 == 0, scale=1).collect())) == brute_top_k(vectors, scale=1, kind="double")


def test_bounds_prune_and_lose_nothing():
    """Vectors near a plane, as embeddings are near few directions: most pairs are never scored."""
    import numpy as np

    rng = np.random.default_rng(2)
    m = np.floor(256 * (rng.normal(size=(2000, 3)) @ rng.normal(size=(3, 64)) + 0.01 * rng.normal(size=(2000, 64))))
    m = m[np.argsort(-(m * m).sum(1))]
    rotation = np.linalg.svd(m.T @ m)[0]
    q = m @ rotation
    made = {"n": 2000, "rows": np.arange(2000), "ids": np.arange(2000), "vectors": m, "rotated": q, "rest": top_k.rests(q), "longest": float(np.sqrt((m[0] ** 2).sum()))}
    block = top_k.Block({k: v.tobytes() if isinstance(v, np.ndarray) else v for k, v in made.items()}, 64)
    truth = m @ m.T
    np.fill_diagonal(truth, -np.inf)
    kth = np.sort(truth, 1)[:, -5]
    scored = 0
    for i in range(0, 2000, 50):
        best, n = top_k.best_of(block, np.array([i]), block, 5, kth[[i]])
        scored += n
        assert [b[1] for b in best] == sorted(truth[i].tolist(), reverse=True)[:5]
    assert scored < 0.05 * 40 * 2000


def test_html_extraction():
    model = html_extract.default_model()
    tp = fp = fn = 0
    for page, content in html_extract.labelled_pages(40, seed=99):
        got = model.extract(page)
        tp, fp, fn = tp + sum(x in content for x in got), fp + sum(x not in content for x in got), fn + sum(x not in got for x in content)
    assert tp / (tp + fp) > 0.95 and tp / (tp + fn) > 0.93
    page = "<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><ul><li><a href='/'>home</a></li></ul></nav><article><h1>A &amp; B</h1><p>First  line\n here.<br>More of it.<p>Second &eacute; line is this one.</article><footer>&copy; me</footer>"
    assert model.extract(page) == ["A & B", "First line here. More of it.", "Second é line is this one."]
    for odd in (None, "", "<", "<p", "<!-- cut", "<script>x", "a < b > c", "<div>" * 5000, "</p></p>", "<p title='a>b'>x</p>", "\0"):
        assert isinstance(model.extract(odd), list)


def test_a_head_ends_where_its_body_begins():
    model = html_extract.default_model()
    body = "<h1>A heading of some words</h1><p>First line is said here.<p>Second line is this one."
    want = ["A heading of some words", "First line is said here.", "Second line is this one."]
    junk = "<meta charset=utf-8><link rel=x href=y><base href=/><style>p{}</style><script>var a='<h1>no</h1></head><body>';</script><noscript><p>no</p></noscript><template><p>no</p></template><!-- <body> -->\n"
    for head in ("<title>t</title>", junk + "<title>About the <body> tag</title>", "", "<title>t", "<title>t" + "\n<meta charset=utf-8>"):
        for end in ("", "</head>", "<body>", "</head><body class=x>", "</HEAD >\n<BODY>"):
            nodes = html_extract.tree(f"<!doctype html><html><head>{head}{end}{body}")
            assert [x.block for x in nodes if x.block is not None] == want, (head, end)
    assert model.extract(f"<!doctype html><head><title>t</title><article>{body}</article>") == want
    assert [x.block for x in html_extract.tree("<head><title>t</title>Plain words") if x.block] == ["Plain words"]
    for odd in ("<head>", "<head><", "<head><script>x", "<head><title>", "<head><!-- cut", "<head></p>", "<head> "):
        assert model.extract(odd) == []


def test_html_tables(spark):
    frame = spark.createDataFrame([(1, "u", None, "own"), (2, "u", "", "own"), (3, None, "<article><h1>Head of it</h1><p>Some words that are said here.</p></article>", "own")], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract(frame).collect()}
    assert got == {1: ("", 0), 2: ("", 0), 3: ("Head of it\n\nSome words that are said here.", 42)}
    assert html_extract.extract(frame.limit(0)).count() == 0


def test_messages_give_exact_marginals():
    import itertools
    import math

    nodes = [html_extract.Node("#root", -1, None, []), html_extract.Node("div", 0, None, []), html_extract.Node("#text", 1, "a", []), html_extract.Node("#text", 1, "b", []), html_extract.Node("#text", 0, "c", [])]
    own, pair = [0.3, -0.7, 1.1, 0.2, -0.4], [[[0.5, -0.2], [-0.9, 0.8]], [[0.1, 0.4], [0.3, -0.6]], [[0.2, 0.0], [-0.1, 0.7]]]
    marginals, joint, total = html_extract.passes(nodes, own, pair)
    z, m = 0.0, [0.0] * 5
    for s in itertools.product((0, 1), repeat=5):
        e = math.exp(sum(o * x for o, x in zip(own, s, strict=True)) + sum(pair[html_extract._kind(n, nodes)][s[n.parent]][s[i]] for i, n in enumerate(nodes) if i))
        z += e
        m = [a + e * x for a, x in zip(m, s, strict=True)]
    assert math.isclose(total, math.log(z)) and all(math.isclose(a, b / z, abs_tol=1e-9) for a, b in zip(marginals, m, strict=True))
    assert all(math.isclose(sum(j), 1) for j in joint[1:])
