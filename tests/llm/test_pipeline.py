"""The pipeline's stages on the smallest tables, each against what it must do to its own input."""

import re
from collections import defaultdict

import corpus_pipeline

SMALL = "/root/testdata/sf0.001"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, kept = docs.columns, [docs.collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(docs.collect())
        if k < 4:
            assert docs.columns == columns
    first, good, exact, near, mixed, packed = kept
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    left = {r.doc_id for r in good}
    assert left < {r.doc_id for r in first} and sum(label.get(r.doc_id) == 1 and r.doc_id not in left for r in first) <= 2

    groups = defaultdict(list)
    for r in good:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r.text or "")].append((-len(r.text or ""), r.doc_id))
    assert sorted(r.doc_id for r in exact) == sorted(min(g)[1] for g in groups.values())

    sets, root = {r.doc_id: shingles(r.text) for r in exact}, {r.doc_id: r.doc_id for r in exact}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert sorted(r.doc_id for r in near) == sorted({find(i) for i in root})
    times = defaultdict(int)
    for r in mixed:
        times[r.doc_id] += 1
    assert set(times) <= {r.doc_id for r in near} and max(times.values()) <= 2
    rows = defaultdict(int)
    for r in packed:
        rows[r.doc_id] += r.length
    totals = {r.doc_id: r.doc_tokens for r in packed}
    assert rows == {i: totals[i] * n for i, n in times.items()}


def test_rows_that_ids_do_not_tell_apart(spark, tmp_path):
    """Repeated rows, copies without an id, and an id that two texts share: one row of each text stays, and none is mixed in more than twice."""
    say = lambda k: " ".join(f"w{k}x{j}" for j in range(40))
    rows = [(7, say(1)), (7, say(1)), (7, say(1)), (None, say(2)), (None, say(2)), (None, say(2) + " "), (8, say(3)), (8, say(4)), (9, say(3) + " z"), (None, say(5)), (None, say(5) + " z"), (1, say(6))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = []
    for name, stage in corpus_pipeline.STAGES[1:4]:
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(sorted((r.doc_id or 0, r.text) for r in docs.collect()))
    exact, near, mixed = kept
    assert exact == sorted([(7, say(1)), (0, say(2) + " "), (8, say(3)), (8, say(4)), (9, say(3) + " z"), (0, say(5)), (0, say(5) + " z"), (1, say(6))])
    assert len(near) == 6 and {t[:6] for _, t in near} == {say(k)[:6] for k in range(1, 7)} and (8, say(3)) in near
    assert set(mixed) <= set(near) and max(map(mixed.count, mixed)) <= 2 and len(mixed) == 9


def test_mixing_repeated_rows(spark):
    """Three rows alike are three rows: two copies of each at most, not of each pair, and within the target."""
    text = " ".join(f"w{j}" for j in range(10))
    docs = spark.createDataFrame([(5, text, "s")] * 3 + [(6, text + " z", "s")] * 3, "doc_id long, text string, source string")
    assert corpus_pipeline.mix_sources(spark, docs, SMALL).count() <= 12 * 0.75 + 1
