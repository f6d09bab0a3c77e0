"""The pipeline's stages on the smallest tables against plain versions."""

import corpus_pipeline
from registra.llm import toxicity
from test_operators import shingles

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "ngram_join", "decontamination", "mixing"]
    kept = stages["toxicity"](spark, docs, DATA)
    assert kept.columns == columns and 0 < kept.count() <= docs.count()
    lines = stages["line_dedup"](spark, docs, DATA)
    assert lines.columns == columns and lines.count() == docs.count() and lines.filter("n_chars <> char_length(text)").count() == 0
    texts = {r.doc_id: r.text for r in docs.collect()}
    sets = {i: shingles(t) for i, t in texts.items()}
    left = {r.doc_id for r in stages["ngram_join"](spark, docs, DATA).collect()}
    near = lambda a, b: 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])
    assert all(i in left for i in sets if not any(i != j and near(i, j) for j in sets))
    assert all(any(j < i and near(i, j) for j in sets) or i in left for i in sets)
    items = [shingles(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in stages["decontamination"](spark, docs, DATA).collect()}
    assert clean == {i for i, s in sets.items() if not any(4 * len(s & x) >= 3 * len(x) for x in items)}


def plain_lines(texts):
    """Line dedup in plain Python."""
    key = lambda x: x.strip(" \t\n\v\f\r").translate({c: c + 32 for c in range(65, 91)})
    held = {}
    for i, t in texts.items():
        for k in {key(x) for x in (t or "").split("\n")}:
            held.setdefault(k, set()).add(i)
    gone = lambda i, k: len(k) >= 20 and len(held[k]) >= 3 and max(held[k]) != i
    return {i: "\n".join(x for x in (t or "").split("\n") if not gone(i, key(x))) for i, t in texts.items()}


def plain_targets(sizes, weights=(5, 2, 1)):
    """Shares of 150 % by weight, none above twice its source; the excess is shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, out, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not full:
            return out | share
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_run_equals_plain_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "toxic")
    rows = {r.doc_id: r for r in docs.collect()}
    numbers, weights, bias = toxicity.fit(docs.select(docs["doc_id"].alias("id"), "text"), labels.withColumnRenamed("doc_id", "id"))
    w = dict(zip(numbers.tolist(), weights.tolist(), strict=True))
    texts = {i: r.text for i, r in rows.items() if bias + sum(w.get(f, 0.0) for f in toxicity.features(r.text).tolist()) < 0}
    assert 0.5 * len(rows) < len(texts) < len(rows)
    texts = plain_lines(texts)
    sets = {i: shingles(t) for i, t in texts.items()}
    lead = {i: i for i in sets}
    for _ in range(6):
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b]):
                    lead[a] = lead[b] = min(lead[a], lead[b])
    items = [shingles(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    left = {i for i in sets if lead[i] == i and not any(4 * len(sets[i] & x) >= 3 * len(x) for x in items)}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, DATA).collect()}
    assert set(got) == left
    size = {i: len(texts[i].encode().split()) for i in left}
    by = {}
    for i in left:
        by[rows[i].source] = by.get(rows[i].source, 0) + size[i]
    target = plain_targets(by)
    taken = dict.fromkeys(by, 0)
    for i, r in got.items():
        s = rows[i].source
        assert (r.size, r.source_size) == (size[i], by[s]) and abs(r.target - target[s]) < 1e-6 * max(1, target[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in by)
