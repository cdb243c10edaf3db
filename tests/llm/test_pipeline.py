"""Each stage on what its predecessor kept, against brute force."""

import re

import numpy as np

import corpus_pipeline
from lodeworks.llm import decontamination, line_dedup, minhash_dedup, quality_rules

from . import helpers as H
from .test_operators import brute_runs


def test_stages(spark, sf, duck):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "minhash_dedup", "decontamination", "piece_sampling"]
    before = docs
    results = []
    for _, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, sf)
        results.append((before, after))
        before = after.cache()
    # quality: exactly the documents that SQL keeps
    kept = {r[0] for r in duck.sql(f"select doc_id from ({quality_rules.OP1_SQL}) where kept").fetchall()}
    assert {r.doc_id for r in results[0][1].collect()} == kept
    # lines: the brute-force texts, without documents that lost all
    pairs = [(r.doc_id, r.text) for r in results[1][0].collect()]
    want = {d: t for d, t in brute_runs(pairs).items() if t == dict(pairs)[d] or t.split()}
    got = {r.doc_id: r for r in results[1][1].collect()}
    assert {d: r.text for d, r in got.items()} == want and all(r.n_chars == len(r.text) for r in got.values())
    # near copies: the least id of each group
    pairs = [(r.doc_id, r.text) for r in results[2][0].collect()]
    want = {d for (d, _), (_, c) in zip(pairs, H.groups(pairs, 5, 80), strict=True) if c == d}
    assert {r.doc_id for r in results[2][1].collect()} == want
    # decontamination: none of the windows is left
    windows = set()
    for (t,) in duck.sql("select text from benchmark").fetchall():
        w = H.plain_words(t)
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    hit = lambda t: any(tuple(w[i : i + n]) in windows for w in [H.plain_words(t)] for n in {len(x) for x in windows} for i in range(len(w) - n + 1))
    assert {r.doc_id for r in results[3][1].collect()} == {r.doc_id for r in results[3][0].collect() if not hit(r.text)}
    # encoding: every document, exactly
    last = results[4][1].collect()
    assert sorted(r.doc_id for r in last) == sorted(r.doc_id for r in results[4][0].collect())
    assert all(x.round_trip for r in last for x in r.samples)
    for b, a in results[:-1]:
        assert a.columns == b.columns == docs.columns


def test_pipeline_of_awkward_documents(spark, sf, tmp_path):
    d = H.awkward(spark)
    for part in (d, H.empty(spark)):
        out = part
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, sf)
        assert out.count() <= part.count()
    assert decontamination.stage and line_dedup.stage and minhash_dedup.stage


def test_changed_copies_make_no_pairs(spark, sf, monkeypatch):
    """Copies of one text, each with its own changed words: near-dedup keeps what brute force keeps, and the pairs beside those with heads grow with the copies, not with their square."""
    rng = np.random.default_rng(6)
    pairs = []
    for i in range(90):
        words = [f"t{k}" for k in range(200)]
        for at in rng.choice(200, 1 + i % 9, replace=False):
            words[at] = f"a{i}x{at}"
        pairs.append((i, " ".join(words)))
    seen = []
    test = minhash_dedup.Linker.test
    monkeypatch.setattr(minhash_dedup.Linker, "test", lambda self, pairs_, name: (seen.append((name, pairs_.count())), test(self, pairs_, name))[1])
    stage = dict(corpus_pipeline.STAGES)["minhash_dedup"]
    got = {r.doc_id for r in stage(spark, spark.createDataFrame(pairs, "doc_id long, text string"), sf).collect()}
    assert got == {d for (d, _), (_, c) in zip(pairs, H.groups(pairs, 5, 80), strict=True) if c == d} and 10 < len(got) < 80
    assert sum(n for name, n in seen if name not in ("first", "heads")) <= 2 * len(pairs), seen


def test_words_are_compared_where_the_key_fits(spark, sf, tmp_path):
    """Decontamination puts the words of a window together at the few places where its hash is found, not at every position as a key of the join; and compares them exactly."""
    item = "a0 a1 a2 a3 a4 Éa5 a6 a7 a8 a9"
    texts = [item, item.upper().replace("É", "é"), "x " + item.replace(" ", ", ").upper(), item.replace("a3", "a33"), item.replace("a3", "a"), item.replace("a3 ", ""), item.replace("a1 a2", "a2 a1"), item.replace("É", "È")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    windows, _, _ = decontamination.benchmark_windows(spark.createDataFrame([("i", item)], "item_id string, text string"))
    windows.write.parquet(f"{tmp_path}/windows")
    found = decontamination.hits(docs, spark.read.parquet(f"{tmp_path}/windows"))
    joins = re.findall(r"BroadcastHashJoin (.*?), Inner", found._jdf.queryExecution().executedPlan().toString())
    assert joins and not any("_orig" in keys for keys in joins), joins
    assert sorted((r.doc_id, r.at) for r in found.collect()) == [(0, 0), (2, 1)]
