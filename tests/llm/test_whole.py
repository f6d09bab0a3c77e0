"""Odd rows that once lost links."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from registra.llm import chat, decontam, fingerprints, langid, mixing, ngram_join, token_counts, toxicity, urlfilter


def test_ngram_join_keeps_the_texts_of_an_id_apart(spark):
    text = lambda *w: " ".join(f"{w[0]}{i}" for i in range(60)) + " " + " ".join(w[1:])
    rows = [(1, text("a")), (1, text("b")), (2, text("a", "more")), (3, text("b", "more")), (None, text("c")), (4, text("c", "more")), (None, text("d")), (None, text("d", "more"))]
    got = ngram_join.jaccard_links(spark.createDataFrame(rows, "id long, text string")).collect()
    assert {(r.id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 1), (None, 4), (4, 4), (None, None)}


def test_short_items_are_found_inside_texts(spark):
    texts = ["one two three four five six seven eight", "Two THREE", "two three", "twothree x y z w v", "x two  three", None]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    items = spark.createDataFrame([(1, "two three"), (2, "eight"), (3, "three four five six"), (4, "two three four five six"), (5, "three two")], "item_id long, text string")
    got = {(r.id, r.item_id, r.n_item, r.n_shared, r.containment) for r in decontam.find_leaks(d, items).collect()}
    assert got == {(i, k, 1, 1, 1.0) for i, k in [(0, 1), (0, 2), (0, 3), (0, 4), (1, 1), (2, 1), (4, 1)]}
    assert decontam.decontaminate(d, items, "id").count() == 2


def test_decontaminate_judges_rows_without_a_key(spark):
    item = " ".join(f"i{k}" for k in range(20))
    rows = [(None, f"x {item} y"), (None, "clean text"), (None, None), (1, item), (1, "clean"), (2, "clean")]
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = decontam.decontaminate(spark.createDataFrame(rows, "id long, text string"), items, "id").collect()
    assert sorted((str(r.id), str(r.text)) for r in got) == [("2", "clean"), ("None", "None"), ("None", "clean text")]


def test_next_texts_whatever_the_ids(spark):
    ids = [*range(1, 700), 2**50, 2**62, -(2**63), 2**63 - 1, None, None, 7, 7]
    rows = [(i, f"text {i} {n % 3}") for n, i in enumerate(ids)]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = sorted((str(a[0]), a[1], order[(k + 1) % len(order)][1]) for k, a in enumerate(order))
    d = spark.createDataFrame(rows, "id long, text string")
    assert sorted((str(r.id), r.text, r.next_text) for r in fingerprints.with_next(d).collect()) == want
    one = fingerprints.with_next(d.filter("id = 50")).collect()
    assert [(r.text, r.next_text) for r in one] == [("text 50 1", "text 50 1")]


def test_leaves_cover_texts_and_follow_edits(spark):
    rng = random.Random(2)
    long = " ".join("".join(rng.choices("abcdefghilmnorstu", k=rng.randrange(1, 12))) for _ in range(3000))
    texts = [long, "New start. " + long, "", "No end", "One. Two!\n\nThree? " * 50, "x" * 1000]
    d = spark.createDataFrame([(t,) for t in texts], "text string").select("text", F.regexp_extract_all("text", F.lit(fingerprints.PARAGRAPH), F.lit(0)).alias("p")).collect()
    assert ["".join(r.p) for r in d] == [r.text for r in d] and all(len(x) <= 300 for r in d for x in r.p)
    by = {r.text: set(r.p) for r in d}
    assert len(by[long] & by["New start. " + long]) > 0.95 * len(by[long])


def test_language_distances_equal_plain_ones(spark):
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choices(letters, k=rng.randrange(2, 9))) for _ in range(60)) for letters in ("aeionst", "bcdaeu", "xyzqj") for _ in range(6)]
    rows = [(i, t, "abc"[i // 6], 0) for i, t in enumerate(texts)] + [(50, None, "a", 0), (51, "x" * 30_000, None, 0), (0, texts[0], "a", 0)]
    d = spark.createDataFrame(rows, "id long, text string, lang string, score int")

    def grams(t):
        words = "".join(c if c.isalpha() else " " for c in t.lower()).split()
        out = []
        for w in words:
            out += list(w)
        marked = " " + " ".join(words) + " "
        return out + [marked[i : i + n] for n in (2, 3) for i in range(len(marked) - n + 1)]

    profiles = langid.learn(d)
    assert [k for k, _ in profiles] == ["a", "b", "c"]
    count = {}
    for _, t, lang, _ in rows:
        if t and lang:
            for g in grams(t):
                count.setdefault(lang, {}).setdefault(g, 0)
                count[lang][g] += 1
    for lang, hashes in profiles:
        least = sorted(count[lang].values(), reverse=True)[: len(hashes)]
        got = langid.grams(" ".join(t for _, t, x, _ in rows if t and x == lang))
        keys, n = np.unique(got, return_counts=True)
        mine = dict(zip(keys.tolist(), n.tolist(), strict=True))
        assert len(least) == len(hashes) and sum(mine.get(h, 0) for h in hashes.tolist()) >= 0.9 * sum(least)
    known = {k: {h: r for r, h in enumerate(v.tolist())} for k, v in profiles}
    for r in langid.predict(d, profiles).collect():
        text = dict((i, t) for i, t, *_ in rows)[r.id]
        if text is None:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        p = langid.profile(langid.grams(text)).tolist()
        far = {k: sum(abs(v[h] - i) if h in v else langid.TOP for i, h in enumerate(p)) for k, v in known.items()}
        assert r.lang_pred == min(sorted(far), key=far.get)


def test_mixing_of_tiny_and_repeated_sources(spark):
    rows = [(i, "w " * 400, "big") for i in range(300)] + [(1000, "a b c", "small"), (1000, "a b c", "small"), (1001, "x", None), (None, "y z", None)]
    d = spark.createDataFrame([(*r, 5) for r in rows], "id long, text string, source string, taken int")
    got = mixing.mix(d, block_words=16).collect()
    assert len(got) == len(rows)
    for source in ("big", "small", None):
        mine = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 1 and all(r.taken <= 2 * r.size for r in mine)


def test_stored_windows_and_token_budgets(spark):
    rows = [(c, i, ("system", "user", "assistant")[min(i, 1 + i % 2)], f"turn {i} of {c} " * (i % 7)) for c in range(4) for i in range(30)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    w = chat.format_windows(d, budget=120, history=40, vocabulary=token_counts.VOCABULARY)
    e = token_counts.encoder(token_counts.VOCABULARY)
    many = w.collect()
    assert len(many) > 8 and all(len(e.encode_ordinary(r.text)) <= 120 for r in many if len(r.loss) > 1)
    mixed = spark.createDataFrame(random.Random(1).sample([tuple(r) for r in many], len(many)), chat.WINDOWS)
    assert sorted(chat.read_windows(mixed).collect()) == sorted(chat.read_windows(w, in_order=True).collect())


def test_toxicity_of_long_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "FIT_BYTES", 40_000)
    rows = [(i, ("fine words here " * 30 + (" you idiot" if i % 3 == 0 else "")) * (1 + i % 2)) for i in range(300)] + [(0, "twice"), (1, "word " * 50_000)]
    d = spark.createDataFrame([(*r, 1) for r in rows], "id long, text string, predicted int")
    labels = d.select("id", (F.col("id") % 3 == 0).cast("int").alias("toxic")).union(d.limit(3).select("id", F.lit(1)))
    got = toxicity.score(d, toxicity.fit(d, labels)).filter("row.text <> 'twice'").collect()
    assert sum(r.predicted == (r["row"]["id"] % 3 == 0) for r in got) > 290


@pytest.mark.parametrize("few_rules", [True, False])
def test_url_rules_in_any_case_and_repeated_rows(spark, few_rules, monkeypatch):
    monkeypatch.setattr(urlfilter, "MOST_BLOCKS", 1 << 24 if few_rules else 2)
    urls = ["http://A.Example.COM/x"] * 3 + [None, None, "http://example.org/" + "y/" * 5000, "http://other.net/"]
    p = spark.createDataFrame([(7, u) for u in urls], "id long, url string")
    more = [(f"h{i}.com", "/", "block") for i in range(0 if few_rules else 500)]
    rules = spark.createDataFrame([("Example.com", "/", "block"), ("example.org", "/y", "block"), ("x", None, "block"), *more], "host string, path string, verdict string")
    got = sorted((str(r.rule), r.verdict) for r in urlfilter.filter_urls(p, rules).collect())
    assert got == sorted([("example.com/", "block")] * 3 + [("None", "allow")] * 3 + [("example.org/y", "block")])


def test_token_counts_of_a_run_without_breaks(spark):
    texts = ["x" * 20_000, "", None, " " * 3000]
    e = token_counts.encoder(token_counts.VOCABULARY)
    got = {r.n_tokens: r.n_docs for r in token_counts.length_table(spark.createDataFrame([(t, 1) for t in texts], "text string, n_docs int")).collect()}
    want = [len(e.encode_ordinary(t or "")) for t in texts]
    assert got == {n: want.count(n) for n in want}
