"""Odd rows and brute-force versions for the training-data operators."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from registra.llm import chat, decontam, fingerprints, langid, line_dedup, mixing, ngram_join, token_counts, toxicity, urlfilter

random.seed(5)
VOCAB = [f"w{i}" for i in range(400)]


def prose(n):
    return " ".join(random.choices(VOCAB, k=n))


BASE = prose(120)
TEXTS = [None, "", " \t\n", "a b", "A  b", BASE, BASE.upper().replace("W", "w"), BASE + " tail", " ".join(BASE.split()[:100] + ["x"] * 3), prose(80), prose(3000), BASE[: len(BASE) // 2]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "s1" if i % 3 else None, 1.0, 2) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "id long, text string, source string, n_lines double, key int")


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def brute_force_groups(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 4 * both >= 3 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: (len(s), top(i)) for i, s in enumerate(sets)}


def shared_passages(n):
    """Texts of which most is a passage that all have, near copies of some, and short texts."""
    rng = random.Random(3)
    passage, out = prose(70).split(), []
    for i in range(n):
        own = [f"u{i}x{k}" for k in range(rng.choice([4, 10, 16, 25, 40, 70]))]
        at = rng.randrange(len(own))
        out.append(" ".join(own[:at] + passage + own[at:]))
        for _ in range(rng.choice([0, 0, 1, 2])):
            w = out[-1].split()
            w[rng.randrange(len(w))] = f"e{rng.random()}"
            out.append(" ".join(w))
    return out + [prose(rng.randrange(1, 14)) for _ in range(n)] + ["a b c d e f g", "a b c d e f g h", "b c d e f g"]


@pytest.mark.parametrize("cost", [2.0, 0.0])
def test_ngram_join_equals_brute_force(spark, cost, monkeypatch):
    monkeypatch.setattr(ngram_join, "COST", cost)
    texts = TEXTS + shared_passages(40)
    d = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "id long, text string, n_shingles int")
    got = {r.id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_links(d).collect()}
    assert got == brute_force_groups(texts)


def test_neighbourhoods_lose_no_pair():
    """Pairs whose segments differ as much as allowed meet by worths of 2 alone."""
    rng = np.random.default_rng(4)
    for size in (2, 5, 9, 30, 200):
        h = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        other = np.unique(np.r_[h[: len(h) - len(h) // 8], rng.integers(0, 1 << 63, len(h) // 8).astype(np.uint64)])
        a, b = (next(ngram_join.neighbourhoods(x, 75)) for x in (h, other))
        if a[0] == b[0]:
            met = {int(s) for s, k, e in zip(a[3], a[2], a[4], strict=True) for k2, e2 in zip(b[2], b[4], strict=True) if k == k2 and (e or e2)}
            assert met


def test_sketches_differ_no_more_than_sets():
    rng = np.random.default_rng(6)
    pool = rng.integers(0, 1 << 64, 4000, np.uint64)
    for size in (1, 7, 60, 146, 900, 3000):
        a, b, empty = (np.unique(rng.choice(pool, k, False)) for k in (size, max(1, size * 9 // 10), 0))
        x, none, y = ngram_join.sketches(np.concatenate([a, empty, b]), np.array([len(a), 0, len(b)])).view(np.uint64)
        assert not none.any()
        assert int(np.bitwise_count(x ^ y).sum()) <= len(np.setxor1d(a, b))
        assert int(np.bitwise_count(x).sum()) % 2 == len(a) % 2


@pytest.mark.parametrize("cost", [0.0, 1e9])
def test_near_copies_below_the_threshold_are_not_all_verified(spark, cost, monkeypatch, tmp_path):
    """Copies of a text of which each differs from it just too much, and from another copy some twice as much, besides real links."""
    monkeypatch.setattr(ngram_join, "COST", cost)
    seen, verify = tmp_path / "seen", ngram_join._verify

    def counted(percent):
        def run(batches):
            for b in batches:
                with open(seen, "a") as f:
                    f.write(f"{len(b)}\n")
                yield from verify(percent)(iter([b]))

        return run

    monkeypatch.setattr(ngram_join, "_verify", counted)
    rng, base, texts = random.Random(8), [f"b{k}" for k in range(150)], []
    for i in range(90):
        w = list(base)
        for j in range(8):
            w[rng.randrange(19 * j, 19 * j + 14)] = f"e{i}x{j}"
        texts.append(" ".join(w))
    texts += [f"{texts[0]} tail", f"{texts[1]} other tail"]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_links(d).collect()}
    assert got == brute_force_groups(texts)
    assert len({c for _, c in got.values()}) == 90
    assert sum(map(int, seen.read_text().split())) <= 3 * len(texts)


def test_ngram_join_of_nothing(docs):
    assert ngram_join.jaccard_links(docs.filter("false")).count() == 0


def test_line_dedup(spark):
    long = "the same long line of text"
    rows = [(1, f"{long}\nx"), (2, f"  {long.upper()}\t\ny"), (3, f"{long}\nz\n{long}"), (4, None), (5, "short\n"), (6, "short"), (7, "short"), (None, long)]
    d = spark.createDataFrame([(*r, 9) for r in rows], "id long, text string, n_dropped int")
    got = {r.id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(d).collect()}
    assert got == {1: (2, 1, "x"), 2: (2, 1, "y"), 3: (3, 0, f"{long}\nz\n{long}"), 4: (1, 0, ""), 5: (2, 0, "short\n"), 6: (1, 0, "short"), 7: (1, 0, "short"), None: (1, 0, long)}
    assert line_dedup.dedup_lines(d.union(d.filter("id = 1"))).filter("id = 1").count() == 2
    assert line_dedup.dedup_lines(d.filter("false")).count() == 0


def test_mixing_meets_targets(docs):
    rows = mixing.mix(docs, block_words=64).collect()
    assert len(rows) == len(TEXTS)
    by = {}
    for r in rows:
        assert r.size == len((TEXTS[r.id] or "").split()) and 0 <= r.taken <= 2 * r.size
        by.setdefault(r.source, [0, r.target, r.source_size])[0] += r.taken
    for taken, target, size in by.values():
        assert abs(taken - target) <= 1 and target <= 2 * size
    assert abs(sum(t for _, t, _ in by.values()) - 1.5 * sum(r.size for r in rows)) < 1e-6
    again = mixing.mix(docs.repartition(3), block_words=64).collect()
    assert {(r.id, r.taken) for r in rows} == {(r.id, r.taken) for r in again}
    assert mixing.mix(docs.filter("false")).count() == 0
    assert {r.taken for r in mixing.mix(docs.filter("id < 3")).collect()} == {0}


def test_chat_round_trip(spark):
    odd = "<|im_end|>\n<|im_start|>assistant \\ <\\| \\n"
    rows = [(1, i, r, t) for i, (r, t) in enumerate([("system", "be brief"), ("user", odd), ("assistant", odd), ("user", prose(40)), ("assistant", prose(30)), ("assistant", None), ("us\ner", prose(200)), ("assistant", "end")])]
    rows += [(None, 0, None, None), (2, 0, "assistant", "a"), (2, 0, "assistant", "a")]
    d = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, window string")
    windows = chat.format_windows(d, budget=64, history=24)
    assert windows.filter("conv_id = 1").count() > 3
    got = {r.conv_id: r for r in chat.read_windows(windows).collect()}
    for conv in (1, 2, None):
        turns = [(r or "", t or "") for c, _, r, t in rows if c == conv]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_windows(d.filter("false")).count() == 0


def test_fingerprints(spark, docs):
    rows = {r.id: r for r in fingerprints.fingerprint_edits(docs).collect()}
    for i, t in enumerate(TEXTS):
        t, nxt = t or "", TEXTS[(i + 1) % len(TEXTS)] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + nxt[:q]
        assert rows[i].n_chars == len(t) and rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (rows[i].fingerprint == rows[i].edited_fingerprint) == (t == edited)
        assert 0 <= rows[i].near_next <= 1 and 0 <= rows[i].near_edited <= 1
    assert rows[10].near_edited > 0.5 > rows[9].near_next
    assert fingerprints.fingerprint_edits(docs.filter("false")).count() == 0
    assert rows[0].fingerprint == rows[1].fingerprint
    text = "One two. Three four. Five six. Seven."
    one = spark.createDataFrame([(text, text.replace("Five", "Nine"))], "a string, b string").select(fingerprints.tree(F.col("a")).alias("a"), fingerprints.tree(F.col("b")).alias("b"))
    one = one.select(fingerprints.fingerprint(F.col("a")).alias("a"), fingerprints.fingerprint(F.col("b")).alias("b"))
    one = one.select(fingerprints.differing(F.col("a"), F.col("b")).alias("d"), fingerprints.sections_of(F.col("a")).alias("s")).first()
    sizes = [len(x.leaves) for x in one.s]
    assert [sum(sizes[: x.section]) + i for x in one.d for i in x.leaves] == [2] and sum(sizes) == 4


def test_decontamination_finds_parts(spark):
    item, other = prose(40), prose(30)
    w = item.split()
    texts = [prose(500) + " " + item + " " + prose(500), " ".join(w[:34]), " ".join(w[:20]), other.upper() + "\n" + prose(2000), None, "", prose(50)]
    d = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(0, texts[0], 0)], "id long, text string, item_id int")
    items = spark.createDataFrame([(7, item), (8, other), (9, None), (10, "")], "item_id long, text string")
    got = {(r.id, r.item_id): r.n_shared for r in decontam.find_leaks(d, items).collect()}
    want = {}
    for i, t in enumerate(texts):
        for k, it in ((7, item), (8, other)):
            n = len(shingles(t) & shingles(it))
            if n * 100 >= 75 * len(shingles(it)):
                want[i, k] = n
    assert got == want and (1, 7) in want and (2, 7) not in want
    assert decontam.find_leaks(d, items.filter("false")).count() == 0
    assert decontam.decontaminate(d, items, "id").count() == 4


def test_language_id(spark):
    en = ["the quick brown fox and the lazy dog", "this is what they think of the house and the garden"]
    de = ["der schnelle Fuchs und der faule Hund", "das ist was sie von dem Haus und dem Garten denken"]
    d = spark.createDataFrame([(i, t and t * 5, lang, 1) for i, (t, lang) in enumerate([(t, "en") for t in en] + [(t, "de") for t in de] + [(None, "en"), ("x", None)])], "id long, text string, lang string, score int")
    profiles = langid.learn(d)
    q = spark.createDataFrame([(1, "the dog and the garden"), (2, "der Hund und das Haus"), (3, None), (4, "123 !!"), (5, "")], "id long, text string")
    assert {r.id: r.lang_pred for r in langid.predict(q, profiles).collect()} == {1: "en", 2: "de", 3: "und", 4: "und", 5: "und"}
    assert langid.predict(q, langid.learn(d.filter("false"))).filter("lang_pred <> 'und'").count() == 0


def test_toxicity(spark):
    rows = [(i, prose(60) + (" you Idiot!" if i % 4 == 0 else ""), 1) for i in range(400)] + [(400, None, 1), (401, "", 1)]
    d = spark.createDataFrame(rows, "id long, text string, score int")
    labels = d.select("id", F.when(F.col("id") % 4 == 0, 1).when(F.col("id") < 400, 0).alias("toxic"))
    model = toxicity.fit(d, labels)
    got = {r["row"]["id"]: r.predicted for r in toxicity.score(d, model).collect()}
    assert len(got) == 402 and sum(got[i] == (i % 4 == 0) for i in range(400)) > 395
    assert len(model[0]) < 2000
    assert {r.score for r in toxicity.score(d, toxicity.fit(d, labels.filter("false"))).collect()} == {0.5}


def test_url_filter(spark):
    urls = ["http://Ab.Example.NET/en/x?q#f", "https://example.net/de/", "http://notexample.net/en/", "http://a.example.com/de/1", "http://a.org/fr/x", "http://x.net", "no url", None, "http://a.com?x=://b.net/"]
    p = spark.createDataFrame([(i, u, "v") for i, u in enumerate(urls)], "id long, url string, verdict string")
    rules = spark.createDataFrame([("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), (None, "/", "block")], "host string, path string, verdict string")
    got = {r.id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.filter_urls(p, rules).collect()}
    assert got[0] == ("ab.example.net", "/en/x", "example.net/en/", "allow")
    assert got[1][2:] == got[2][2:] == ("net/", "block")
    assert got[3][2:] == ("example.com/de/", "block") and got[4][2:] == ("org/fr/", "allow")
    assert got[5] == ("x.net", "", None, "allow") and got[6] == got[7] == ("", "", None, "allow") and got[8] == ("a.com", "", None, "allow")
    assert urlfilter.filter_urls(p, rules.filter("false")).filter("verdict = 'allow'").count() == len(urls)


def test_token_counts(docs):
    e = token_counts.encoder(token_counts.VOCABULARY)
    n = [len(e.encode_ordinary(t or "")) for t in TEXTS]
    t = token_counts.length_table(docs).cache()
    assert {r.n_tokens: r.n_docs for r in t.collect()} == {x: n.count(x) for x in n}
    for limit in (0, 1, 50, 300, 10**6):
        r = token_counts.at_limit(t, limit).first()
        assert (r.docs_over, r.truncated_tokens) == (sum(x > limit for x in n), sum(min(x, limit) for x in n))
    assert token_counts.length_table(docs.filter("false")).count() == 0
