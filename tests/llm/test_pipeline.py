"""The corpus pipeline, stage by stage, against brute force; and the registry."""

import base64
import hashlib
import random
import re

import public_tokenizers as P
from test_text_operators import brute_components, words

import corpus_pipeline
from voxelweave.llm import queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    import tiktoken

    rng = random.Random(8)
    texts = {i: words(rng, rng.randint(60, 160), 4000) for i in range(150)}
    for i in range(20):
        texts[200 + i] = texts[i].replace(texts[i].split()[3], "other", 1)
    for i in range(20, 30):
        texts[200 + i] = texts[i]
    passage = words(rng, 40, 4000)
    for i in range(40, 50):
        texts[i] += " " + passage
    item = words(rng, 30, 4000)
    texts[60] = " ".join(texts[60].split()[:40]) + " " + item
    for i in range(70, 85):
        texts[i] = texts[i].replace(" ", " idiot ", 2)
    for i in range(90, 100):
        texts[i] = " ".join(w + "%%%" for w in texts[i].split())
    d = str(tmp_path)
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()] + [(999, None, None, None, None)], DOCS)
    frame.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    bad = {*range(70, 85), *range(90, 100)}
    marks = [(i, int(i not in range(90, 100)), int(i in range(70, 85))) for i in texts if i % 2 == 0]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        if name != "byte-level BPE":
            assert out.dtypes == docs.dtypes
        out.write.parquet(f"{d}/{len(seen)}")
        docs = spark.read.parquet(f"{d}/{len(seen)}")
        seen.append({r[0]: r for r in docs.collect()})
    first, second, third, fourth, last = seen
    assert set(first) == set(texts) - bad
    kept = {i for i, _, c in brute_components([(i, texts[i]) for i in first]) if i == c}
    assert set(second) == kept and not kept & set(range(220, 230))
    strings, expect = set(), {}
    for i in sorted(second):
        b = texts[i].encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s : s + 100] in strings:
                gone[s : s + 100] = b"\x01" * 100
            strings.add(b[s : s + 100])
        expect[i] = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode()
    assert {i: r.text for i, r in third.items()} == {i: t for i, t in expect.items() if t.strip()}
    assert all(r.n_chars == len(r.text) for r in third.values()) and any(len(third[i].text) < len(texts[i]) for i in range(41, 50))
    assert set(third) - set(fourth) == {60}
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, r in last.items():
        ids = own.encode_ordinary(fourth[i].text)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(fourth[i].text.encode()).hexdigest()
    assert corpus_pipeline.ORACLE_SQL is None


def test_near_copies_of_rows_that_share_an_id_or_have_none(spark):
    rng = random.Random(9)
    a, b, c, d, e, f, g, h, k = (words(rng, 80, 4000) for _ in range(9))
    near = lambda t: t.replace(t.split()[3], "other", 1)
    rows = [
        (1, a), (1, a), (1, b), (1, None), (1, None),  # one id: a repeats, b and the empty ones are clean
        (2, c), (3, near(c)), (3, d),  # one of the two texts of id 3 is a copy
        (4, near(e)), (4, e),  # two texts of one id are linked: one stays
        (None, f), (None, g), (None, g), (None, near(g)),  # without an id: f is clean, g repeats and has a near copy
        (None, h), (5, near(h)),  # the one with an id stays
        (None, near(a)), (6, k), (None, None), (None, ""),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    out = corpus_pipeline.near_copies_stage(spark, docs, "")
    assert out.dtypes == docs.dtypes
    got = [(r.doc_id, r.text) for r in out.collect()]
    loose = [x for x in got if x[1] in (e, near(e), g, near(g))]
    assert sorted(i or 0 for i, _ in loose) == [0, 4] and len({t in (g, near(g)) for _, t in loose}) == 2
    assert sorted((x for x in got if x not in loose), key=str) == sorted([(1, a), (1, b), (1, None), (1, None), (2, c), (3, d), (None, f), (5, near(h)), (6, k), (None, None), (None, "")], key=str)
    assert corpus_pipeline.near_copies_stage(spark, docs.limit(0), "").count() == 0


def test_stages_of_odd_tables(spark, tmp_path):
    rng = random.Random(10)
    d = str(tmp_path)
    lexicon = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(4000)]
    words = lambda rng, n, _: " ".join(rng.choice(lexicon) for _ in range(n))  # noqa: E731  without digits, as these are prose
    spark.createDataFrame([(1, words(rng, 30, 4000))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    clash = {c: "own" for c in ("keep", "hits", "items", "n_hit", "first", "_n", "kept", "spans", "carry", "contaminated", "n_words", "low_quality")}
    texts = [(i, words(rng, 80, 4000)) for i in range(6)] + [(None, words(rng, 80, 4000)), (None, words(rng, 80, 4000)), (3, words(rng, 80, 4000)), (7, None), (8, ""), (9, "one")]
    rows = [(i, t, None, None, None, *clash.values()) for i, t in texts]
    docs = spark.createDataFrame(rows, DOCS + "".join(f", {c} string" for c in clash))
    whole = {t for _, t in texts if t and len(t) > 10}
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, docs, d), stage(spark, docs.limit(0), d)
        assert none.count() == 0, name
        if name == "byte-level BPE":
            assert out.count() == len(rows)
            continue
        assert out.dtypes == docs.dtypes == none.dtypes
        got = out.collect()
        assert whole <= {r.text for r in got}, name
        assert all(r[c] == "own" for r in got for c in clash), name
        assert [r.lang for r in got] == [None] * len(got)


def test_registry():
    names = queries.queries()
    assert [n for k in range(1, 11) for n in names if re.match(rf"op{k}_", n)] == [n for n in names if n != "pipeline"] and "pipeline" in names
    assert set(queries.oracle_sql()) <= set(names)
