"""Each operator against SQL or brute force, on the sample tables and on awkward rows."""

import hashlib
import math
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodeworks.llm import common, decontamination, exchange, license_scan, line_dedup, lm_scoring, minhash_dedup, piece_sampling, quality_rules, suffix_dedup, url_filters, warc
from lodeworks.llm.queries import ORACLE, QUERIES

from ..compare import rows
from . import helpers as H


@pytest.mark.parametrize("name", list(ORACLE))
def test_sql(spark, sf, duck, name):
    assert rows(QUERIES[name](spark, sf).toPandas()) == rows(duck.sql(ORACLE[name]).df())


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "doc_id long, text string")


# --- 1 -------------------------------------------------------------------------------------------------------------------
def test_quality_awkward(spark):
    d = H.awkward(spark)
    judged = quality_rules.judge(d).collect()
    assert len(judged) == d.count() and not any(r.kept for r in judged if r.n_words < 50)
    got = quality_rules.filter_documents(d)
    assert got.columns == d.columns and {r.doc_id for r in got.collect()} == {6}
    assert quality_rules.filter_documents(H.empty(spark)).count() == 0


def test_quality_sketch_merges(spark):
    r = spark.range(5000).select(F.lit("g").alias("k"), (F.col("id") * 7919 % 10007).alias("m"))
    whole = quality_rules.sketch(r, ["k"], ["m"])
    parts = quality_rules.merge(quality_rules.sketch(r.where("m % 3 = 0"), ["k"], ["m"]).unionByName(quality_rules.sketch(r.where("m % 3 <> 0"), ["k"], ["m"])), ["k"])
    assert sorted(whole.collect()) == sorted(parts.collect())
    q = quality_rules.quantiles(whole, ["k"]).first()
    exact = sorted(x.m for x in r.collect())
    for got, at in ((q.q10, 499), (q.q50, 2499), (q.q90, 4499), (q.q99, 4949)):
        assert abs(got - exact[at]) <= exact[at] / 64 + 1


def test_quality_thresholds_follow_the_group(spark):
    words = " ".join(f"word{i}" for i in range(80))
    noisy = " ".join(f"word{i}#{'#' * (i % 3)}" for i in range(80))
    plain = [(i, words + f" x{i}", "en", "prose") for i in range(150)]
    code = [(1000 + i, noisy + f" x{i}", "en", "code") for i in range(150)]
    d = spark.createDataFrame([*plain, *code, (5000, noisy, "en", "prose")], "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality_rules.filter_documents(d).collect()}
    assert kept == {*range(150), *range(1000, 1150)}  # what is usual in code is an outlier in prose


def test_quality_each_measure_acts_below_the_base_rule(spark):
    """Two sources of one language, one with more of everything: its limits are higher, and each measure rejects a planted document that the base rule passes."""
    import random

    rng = random.Random(5)

    def doc(words, mark=0.0, again=0, size=6):
        out = ["".join(rng.choice("abcdefghijklmnop") for _ in range(max(1, round(rng.gauss(size, 0.3)))) ) + ("#" if rng.random() < mark else "") for _ in range(words)]
        lines = [" ".join(out[i : i + 10]) for i in range(0, words, 10)]
        return "\n".join(lines + lines[:again])

    rows = [(i, doc(200, 0.05 * (i % 10 == 0), i % 50 == 0), "en", "plain") for i in range(300)]
    rows += [(1000 + i, doc(200, 0.3 if i % 2 else 0.25, (i % 10 == 0) * 3, 8), "en", "noisy") for i in range(300)]
    planted = {1: doc(200, 0.9), 2: doc(200, 0, 5), 3: doc(200, 0, 0, 14), 4: doc(200, 0, 0, 2)}
    rows += [(5000 + i, t, "en", "plain") for i, t in planted.items()]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality_rules.judge(d).collect()}
    assert not any(r.base_failed for r in got.values())
    a, b = got[0], got[1000]
    assert a.t_m_symbols < b.t_m_symbols and a.t_m_dup_lines < b.t_m_dup_lines and a.t_m_repeats < b.t_m_repeats and a.t_m_word_length < b.t_m_word_length and a.t_m_word_length_low < b.t_m_word_length_low
    assert got[5001].m_symbols > a.t_m_symbols and got[5002].m_dup_lines > a.t_m_dup_lines and got[5002].m_repeats > a.t_m_repeats and got[5003].m_word_length > a.t_m_word_length and got[5004].m_word_length < a.t_m_word_length_low
    assert {i for i, r in got.items() if not r.kept} == {5001, 5002, 5003, 5004}


def test_quality_junk_cant_raise_its_own_limit(spark):
    """A source in which a third of the documents are junk is held by its language's sketch."""
    words = " ".join(f"w{i}" for i in range(80))
    rows = [(i, words + f" x{i}", "en", f"s{i % 5}") for i in range(1000)] + [(5000 + i, (words + f" x{i} ") + "#" * (200 + i), "en", "bad") for i in range(60)] + [(6000 + i, words + f" y{i}", "en", "bad") for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = quality_rules.judge(d).where("not kept").collect()
    assert {r.doc_id for r in got} == {5000 + i for i in range(60)}


# --- 2 -------------------------------------------------------------------------------------------------------------------
def benchmark(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")


def test_decontamination_windows(spark):
    d = frame(spark, [(0, "x " + H.BASE.upper() + "!"), (1, "short item here"), (2, "Short, ITEM -- here short item here"), (3, None), (4, " ".join(H.BASE.split()[:9])), (5, "ΑΣ'B ok"), (5, "ΑΣ'B ok")])
    b = benchmark(spark, H.BASE, H.BASE, "Short item here", None, "", "αΣ'b nothing", "ΑΣ b ok")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontamination.contamination(d, b).collect()}
    assert got == {0: (21, 20, 2, True), 1: (3, 3, 1, True), 2: (6, 6, 1, True), 3: (0, 0, 0, False), 4: (9, 0, 0, False), 5: (3, 3, 1, True)}
    sha = {r.doc_id: r.items_sha256 for r in decontamination.contamination(d, b).collect()}
    assert sha[0] == hashlib.sha256(b"0,1").hexdigest() and sha[3] == hashlib.sha256(b"").hexdigest()


def test_decontamination_spans_and_documents(spark):
    d = H.awkward(spark)
    b = benchmark(spark, H.BASE)
    kept = decontamination.drop_documents(d, b)
    assert kept.columns == d.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [2, 3, 4, 6, 7, 7, 9, 10]))
    cut = {r.doc_id: r.text for r in decontamination.remove_spans(d, b).collect() if r.doc_id in (5, 9)}
    assert cut[5].split() == ["more"] and cut[9].startswith("MIT license")
    assert decontamination.drop_documents(d, benchmark(spark, None)).count() == d.count()
    assert decontamination.drop_documents(H.empty(spark), b).count() == 0


@pytest.mark.parametrize("blocks", [2_000_000, 0])
def test_decontamination_without_broadcast(spark, monkeypatch, blocks):
    """Joined by shuffle, with and without the Bloom filter, in blocks of few rows: the same, for every awkward document and a window that half of them hold."""
    pairs = [(0, H.BASE), (1, "clean"), (2, "Short, ITEM -- here short item here"), (5, "ΑΣ'B ok"), (5, "other text of 5"), *((10 + i, f"x{i} {H.BASE} short item here") for i in range(30))]
    d = frame(spark, pairs).unionByName(H.awkward(spark).select("doc_id", "text"))
    b = benchmark(spark, H.BASE, H.BASE, "short item here", "αΣ'b nothing", "Σ b ok", None, "").unionByName(spark.createDataFrame([(None, "two words")], "item_id long, text string"))
    want = sorted(map(str, decontamination.contamination(d, b).collect()))
    monkeypatch.setattr(decontamination, "MAX_BROADCAST", 0)
    monkeypatch.setattr(decontamination, "MAX_BLOCKS", blocks)
    monkeypatch.setattr(common, "SPREAD_BLOCK", 7)
    assert sorted(map(str, decontamination.contamination(d, b).collect())) == want


def test_decontamination_of_items_without_an_id(spark):
    """Their windows count, though they have no name."""
    d = frame(spark, [(0, H.BASE), (1, "short item here"), (2, "clean"), (None, "short item here")])
    b = spark.createDataFrame([(None, H.BASE), (None, "short item here"), (4, "Short item here")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontamination.contamination(d, b).collect()}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    assert got == {0: (20, 0, sha(b""), True), 1: (3, 1, sha(b"4"), True), 2: (0, 0, sha(b""), False), None: (3, 1, sha(b"4"), True)}


# --- 3 -------------------------------------------------------------------------------------------------------------------
def test_lm_counts_and_gain(spark, docs):
    got = {r.doc_id: r for r in lm_scoring.score_documents(frame(spark, docs)).collect()}
    tokens = {d: [*H.space_words(H.low(t)), None] for d, t in docs}
    c = Counter(w for d, ws in tokens.items() if not H.held_out(d) for w in ws)
    n, v = sum(c.values()), len(c)
    for d, ws in tokens.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (H.held_out(d), len(ws), sum(w in c for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel_tol=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # held-out accuracy


def test_lm_brute_force(spark):
    """All counts and the score of a small corpus, with the weights that were learned."""
    texts = [(i, f"the cat {'sat' if i % 3 else 'ran'} on the mat {i % 5}") for i in range(60)]
    got = {r.doc_id: r.score for r in lm_scoring.score_documents(frame(spark, texts)).collect()}
    trained = [[*t.split(), None] for d, t in texts if not H.held_out(d)]
    uni, bi = Counter(w for s in trained for w in s), Counter(b for s in trained for b in zip(["^", *s], s, strict=False))
    ctx = Counter({**uni, "^": len(trained)})
    n, v = sum(uni.values()), len(uni)
    rest = [[*t.split(), None] for d, t in texts if not H.held_out(d) and __import__("zlib").crc32(str(d).encode()) % 10 != 1]
    held = [[*t.split(), None] for d, t in texts if __import__("zlib").crc32(str(d).encode()) % 10 == 1]
    u2, b2 = Counter(w for s in rest for w in s), Counter(b for s in rest for b in zip(["^", *s], s, strict=False))
    c2, n2 = Counter({**u2, "^": len(rest)}), sum(u2.values())
    events = Counter()
    for s in held:
        for u, w in zip(["^", *s], s, strict=False):
            p2 = b2[u, w] / c2[u] if c2[u] else 0.0
            q = lm_scoring.bins(np.array([p2 * (v + 1), u2[w] / n2 * (v + 1)]))
            events[(int(lm_scoring.bucket(np.array([c2[u]]))[0]), *q.tolist())] += 1
    weights = lm_scoring.learn(np.array([[*k, x] for k, x in events.items()], float))
    for d, t in texts:
        s = [*t.split(), None]
        total = 0.0
        for u, w in zip(["^", *s], s, strict=False):
            a = weights[int(lm_scoring.bucket(np.array([ctx[u]]))[0])]
            total += math.log10(a[0] * (bi[u, w] / ctx[u] if ctx[u] else 0) + a[1] * uni[w] / n + a[2] / (v + 1))
        assert math.isclose(got[d], total, rel_tol=1e-9)


def test_lm_awkward(spark):
    got = lm_scoring.score_documents(H.awkward(spark)).collect()
    assert len(got) == 13 and all(math.isfinite(r.score) and r.score < 0 for r in got) and all(r.held_out for r in got if r.doc_id is None)
    assert lm_scoring.score_documents(H.empty(spark)).count() == 0
    assert all(math.isfinite(r.score) for r in lm_scoring.score_documents(frame(spark, [(None, "only held out")])).collect())


def test_lm_learns_where_the_em_fold_is_empty(spark):
    ids = [i for i in range(200) if __import__("zlib").crc32(str(i).encode()) % 10 > 1]
    got = lm_scoring.score_documents(frame(spark, [(i, "the cat sat on the mat") for i in ids])).collect()
    assert all(r.score > r.base_score > r.n_tokens * math.log10(1 / 7) for r in got)  # five words, the end and an unknown one


@pytest.mark.parametrize("ranges", [1, 3, 300])
def test_lm_totals_beyond_32_bits(spark, ranges):
    """Direct and in two hops."""
    keys, most = np.array([3, 9, 2**63, 2**64 - 1], np.uint64), [np.array([3 * 10**9, 1, 2**40, 5], np.uint64), np.array([7, 2, 0, 0], np.uint64)]
    e = lm_scoring.counting(ranges)
    asked = [row for chunk in "abc" for row in e.ask(chunk, [keys, *most])[0]]
    back, found = e.run(spark.createDataFrame(asked, exchange.ASKED), 3, "x")
    got = [[c.tolist() for c in exchange.joined(r.replies, lm_scoring.REPLIES)] for r in back.collect()]
    assert found == 4 and got == [[[9 * 10**9, 3, 3 * 2**40, 15], [21, 6, 0, 0]]] * 3


def test_lm_in_two_hops(spark, monkeypatch):
    """Many ranges, pools of chunks: the same scores, and rows in proportion to the root of the ranges."""
    d = frame(spark, [(i, " ".join(f"w{(i * 31 + k * k) % 257}" for k in range(60))) for i in range(300)]).repartition(4)
    want = {r.doc_id: r for r in lm_scoring.score_documents(d).collect()}
    monkeypatch.setattr(exchange, "DIRECT", 2)
    monkeypatch.setattr(lm_scoring, "ranges_for", lambda keys: 40)
    assert lm_scoring.counting(40).slices == 7 and lm_scoring.counting(40).per == 6
    got = {r.doc_id: r for r in lm_scoring.score_documents(d).collect()}
    assert all(got[i].n_known == want[i].n_known and math.isclose(got[i].score, want[i].score, rel_tol=1e-12) and math.isclose(got[i].base_score, want[i].base_score, rel_tol=1e-12) for i in want)


def test_em_prefers_the_better_estimate():
    w = lm_scoring.learn(np.array([[5, 40, 4, 900], [5, -10000, 8, 100]], float))
    assert w[5, 0] > 0.5 and abs(w[5].sum() - 1) < 1e-9 and w[0, 0] == 0 and (w[:, 2] > 0).all()


# --- 4 -------------------------------------------------------------------------------------------------------------------
def brute_lines(pairs):
    """Texts after removal, chunk by chunk in order of documents."""
    seen, out = {}, []
    for d, t in sorted(set(pairs), key=lambda x: (x[0] is None, x[0] or 0)):
        for _, _, ls in line_dedup.chunks((t or "").encode()):
            if line_dedup.eligible(ls):
                seen.setdefault(b"\n".join(ls), (d, t))
    first = {}
    for d, t in sorted(set(pairs), key=lambda x: (x[0] is None, x[0] or 0)):
        keep = []
        for i, (_, _, ls) in enumerate(line_dedup.chunks((t or "").encode())):
            body = b"\n".join(ls)
            if not line_dedup.eligible(ls) or first.setdefault(body, (d, t, i)) == (d, t, i):
                keep += ls
        out.append((d, None if t is None else b"\n".join(keep).decode()))
    return out


def test_line_dedup_brute_force(spark, docs):
    got = {r.doc_id: r.text for r in line_dedup.dedup(frame(spark, docs)).collect()}
    assert got == dict(brute_lines(docs)) and any(got[d] != t for d, t in docs)


def test_line_dedup_shifted_passage(spark):
    passage = "\n".join(f"line number {i} of a passage" for i in range(40))
    d = frame(spark, [(1, passage), (2, "intro\n" + passage + "\noutro"), (3, "other\ntext")])
    got = {r.doc_id: r for r in line_dedup.dedup(d).collect()}
    assert got[1].text == passage and got[3]._n_lost == 0 and got[2]._n_lost >= 30 and got[2].text.startswith("intro")


def test_line_dedup_compares_bytes(spark, monkeypatch):
    """Chunks that share a hash are told apart: a hash of one value for all, in the tasks' own module."""
    pairs = [(1, "a b\nc d"), (2, "e f\ng h"), (3, "a b\nc d")]

    def same(batches):
        for b in line_dedup_find(batches):
            yield b.set_column(3, "h", __import__("pyarrow").array([7] * b.num_rows, "int64"))

    line_dedup_find = line_dedup.find
    monkeypatch.setattr(line_dedup, "find", same)
    monkeypatch.setattr(line_dedup, "chunks", line_dedup.chunks)
    got = {r.doc_id: r._n_lost for r in line_dedup.dedup(frame(spark, pairs)).collect()}
    whole = [len(line_dedup.chunks(t.encode())) == 1 for _, t in pairs]
    assert got == {1: 0, 2: 0, 3: 2 if all(whole) else got[3]}


def brute_runs(pairs):
    """Lines that stay: those in no window of two lines, or chunk, whose least place is elsewhere."""
    first, units, rows_ = {}, [], sorted(set(pairs), key=lambda x: (x[0] is None, x[0] or 0))
    for k, (_, t) in enumerate(rows_):
        lines = (t or "").encode().split(b"\n")
        units += [(k, i, i + 2, b"\n".join(lines[i : i + 2])) for i in range(len(lines) - 1) if (lines[i] + lines[i + 1]).strip()]
    gone = {(k, i) for k, a, b, body in units if first.setdefault(body, (k, a)) != (k, a) for i in range(a, b)}
    first = {}
    for k, (_, t) in enumerate(rows_):
        for a, b, ls in line_dedup.chunks((t or "").encode()):
            if line_dedup.eligible(ls) and first.setdefault(b"\n".join(ls), (k, a)) != (k, a):
                gone |= {(k, i) for i in range(a, b)}
    return {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (k, i) not in gone) for k, (d, t) in enumerate(rows_)}


def test_line_dedup_runs_to_their_edges(spark):
    """Two and three lines of other surroundings, wherever chunks end; one line alone and the first copy stay."""
    pairs = []
    for i in range(30):
        shared = [f"shared {i} line {k}" for k in range(2 + i % 3)]
        pairs += [(2 * i, "\n".join([f"a{i}", *shared, f"b{i}", "alone"])), (2 * i + 1, "\n".join([f"c{i}", f"d{i}", *shared, f"e{i}", "alone", f"f{i}"]))]
    got = {r.doc_id: r.text for r in line_dedup.dedup_runs(frame(spark, pairs)).collect()}
    assert got == {d: t if d % 2 == 0 else f"c{d // 2}\nd{d // 2}\ne{d // 2}\nalone\nf{d // 2}" for d, t in pairs}


def test_line_dedup_runs_brute_force(spark, sf, docs):
    got = {r.doc_id: r.text for r in line_dedup.op4_line_dedup(spark, sf).collect()}
    assert got == brute_runs(docs)


def test_line_dedup_awkward(spark):
    d = H.awkward(spark)
    got = line_dedup.stage(spark, d, "")
    assert got.columns == d.columns and got.count() == d.count()
    assert {r["_id"] for r in got.collect()} == {r["_id"] for r in d.collect()}
    assert line_dedup.stage(spark, H.empty(spark), "").count() == 0


# --- 5 -------------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("params", [minhash_dedup.CONTRACT, minhash_dedup.PIPELINE])
def test_minhash_brute_force(spark, docs, params):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.groups(frame(spark, docs), params).collect()}
    assert got == dict(zip([d for d, _ in docs], H.groups(docs, params.words, params.percent), strict=True))


def test_minhash_chains_and_blocks(spark, monkeypatch):
    """A chain of documents, each near the next only, and many near copies of one, in blocks of two."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", 2)
    base = [f"t{i}" for i in range(200)]
    chain = [(100 - i, " ".join(base[4 * i : 4 * i + 120])) for i in range(8)]
    copies = [(500 + i, " ".join([*[f"z{k}" for k in range(120)], f"own{i}"])) for i in range(12)]
    pairs = [*chain, *copies, (900, "something else entirely here now")]
    got = {r.doc_id: r.component_id for r in minhash_dedup.groups(frame(spark, pairs), minhash_dedup.CONTRACT).collect()}
    assert got == {d: c for (d, _), (_, c) in zip(pairs, H.groups(pairs, 3, 85), strict=True)}
    assert len({got[d] for d, _ in chain}) == 1 and len({got[d] for d, _ in copies}) == 1


def test_minhash_templates_make_no_pairs(spark, monkeypatch):
    """Documents that share most of a template but lie under the threshold are candidates of one another; none is compared but those with a rare shingle in common."""
    rng = np.random.default_rng(3)
    template = [f"t{i}" for i in range(100)]
    own = lambda i, n: [f"o{i}x{k}" for k in range(n)]
    pairs = [(i, " ".join([*template, *own(i, 24)])) for i in range(60)]  # 0.68 to one another
    pairs += [(1000 + i, " ".join([*template, *own(i, 20), *own(500 + i, 4)])) for i in range(0, 60, 7)]  # links
    rng.shuffle(pairs)
    pairs = [(int(d), str(t)) for d, t in pairs]
    seen = []
    test = minhash_dedup.Linker.test
    monkeypatch.setattr(minhash_dedup.Linker, "test", lambda self, pairs_, name: (seen.append((name, pairs_.count())), test(self, pairs_, name))[1])
    got = {r.doc_id: r.component_id for r in minhash_dedup.groups(frame(spark, pairs), minhash_dedup.Params(3, 85, 1, 10)).collect()}
    assert got == {d: c for (d, _), (_, c) in zip(pairs, H.groups(pairs, 3, 85), strict=True)}
    assert len(set(got.values())) == 60 and dict(seen)["mixed"] <= 9


def test_minhash_changed_copies_make_no_pairs(spark, monkeypatch):
    """Copies of one text, each with its own changed words, all share rare shingles of that text. Pairs are few, and all links are found: those of copies near the text, and those
    of copies far from it that have changes in common."""
    rng = np.random.default_rng(4)

    def changed(words, n, name):
        out = list(words)
        for at in rng.choice(len(words), n, replace=False):
            out[at] = f"{name}x{at}"
        return out

    text = [f"t{i}" for i in range(200)]
    copies = [changed(text, 1 + i % 10, f"a{i}") for i in range(80)]
    for i in range(6):
        far = changed(text, 12, f"b{i}")
        copies += [changed(far, 1 + j, f"b{i}c{j}") for j in range(3)]
    pairs = [(int(d), " ".join(c)) for d, c in zip(rng.permutation(len(copies)), copies, strict=True)]
    seen = []
    test = minhash_dedup.Linker.test
    monkeypatch.setattr(minhash_dedup.Linker, "test", lambda self, pairs_, name: (seen.append((name, pairs_.count())), test(self, pairs_, name))[1])
    got = {r.doc_id: r.component_id for r in minhash_dedup.groups(frame(spark, pairs), minhash_dedup.Params(3, 85, 1, 10)).collect()}
    want = {d: c for (d, _), (_, c) in zip(pairs, H.groups(pairs, 3, 85), strict=True)}
    assert got == want and 10 < len(set(want.values())) < 90
    assert sum(n for name, n in seen if name not in ("first", "heads")) <= 2 * len(pairs), seen


def test_minhash_awkward(spark):
    d = H.awkward(spark)
    rows_ = [(r.doc_id, r.text) for r in d.collect()]
    got = minhash_dedup.groups(d, minhash_dedup.CONTRACT).collect()
    want = Counter((d_, n, c) for (d_, _), (n, c) in zip(rows_, H.groups(rows_, 3, 85), strict=True))
    # a text without words is a group of its own row
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    kept = minhash_dedup.keep_one(d, minhash_dedup.CONTRACT)
    assert kept.columns == d.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 3, 4, None, 6, 7, 7, 9, 10])
    assert minhash_dedup.keep_one(H.empty(spark)).count() == 0


def test_components_of_a_path(spark):
    from lodeworks.llm.components import components

    e = spark.range(60).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    got = {(r.node, r.component) for r in components(e.unionByName(spark.createDataFrame([(100, 101), (101, 100)], "u long, v long"))).collect()}
    assert got == {*((i, 0) for i in range(61)), (100, 100), (101, 100)}


# --- 6 -------------------------------------------------------------------------------------------------------------------
def test_warc_round_trip(spark, tmp_path):
    recs = [(1, "http://a/", "same"), (2, "http://b/\r\nX: y", "same"), (3, None, None), (4, "http://c/", ""), (5, "http://d/", "ünï"), (None, "http://e/", "same"), (2, "http://b/\r\nX: y", "same"), (6, "u", "small")]
    r = spark.createDataFrame(recs, "record_id long, target string, payload string")
    warc.write_archive(r, str(tmp_path / "a"), min_bytes=4)
    got = Counter((x.record_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in warc.read_index(spark, str(tmp_path / "a")).collect())
    want = Counter()
    for i, _, p in recs:
        data = (p or "").encode()
        top = max(j or -1 for j, _, q in recs if (q or "") == (p or ""))
        kind = "revisit" if len(data) >= 4 and (i or -1) < top else "response"
        want[i, len(data), warc.base32_sha1(data), kind, top if kind == "revisit" else None] += 1
    assert got == want
    full = warc.reconstruct(spark, str(tmp_path / "a")).collect()
    assert Counter(bytes(x.payload) for x in full) == Counter((p or "").encode() for _, _, p in recs)
    stored = spark.read.parquet(str(tmp_path / "a" / "payloads"))
    assert stored.count() == stored.distinct().count() == 4
    for header, block in warc.parse_warc(b"".join(bytes(x.record) for x in full)):
        head, _, body = block.partition(b"\r\n\r\n")
        assert header.startswith(b"WARC/1.1\r\n") and re.search(rb"\r\nWARC-Date: \d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ\r\n", header) and head.startswith(b"HTTP/1.1 200 OK\r\n")
        assert (b"revisit" in header) == (b"Refers-To" in header) and (b"revisit" not in header or body == b"")
    with pytest.raises(ValueError):
        list(warc.parse_warc(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nx"))


def test_warc_null_ids_dont_multiply(spark, tmp_path):
    """Pages without an id, with one payload and with several; and a payload in blocks."""
    recs = [(None, "a", f"p{i % 3}") for i in range(12)] + [(7, "b", "p0")]
    r = spark.createDataFrame(recs, "record_id long, target string, payload string").withColumn("date", F.lit("2020-02-03 04:05:06").cast("timestamp_ntz"))
    warc.write_archive(r, str(tmp_path / "a"))
    got = Counter((x.record_id, x.payload_digest, x.record_type, x.refers_to) for x in warc.read_index(spark, str(tmp_path / "a")).collect())
    sha = [warc.base32_sha1(f"p{i}".encode()) for i in range(3)]
    assert got == {(None, sha[0], "revisit", 7): 4, (7, sha[0], "response", None): 1, (None, sha[1], "response", None): 4, (None, sha[2], "response", None): 4}
    assert spark.read.parquet(str(tmp_path / "a" / "payloads")).count() == 3
    assert all(b"WARC-Date: 2020-02-03T04:05:06Z" in bytes(x.record) for x in warc.reconstruct(spark, str(tmp_path / "a")).collect())


def test_warc_of_hot_payloads_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 10)
    r = spark.range(200).select(F.col("id").alias("record_id"), F.col("id").cast("string").alias("target"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("payload"), F.lit("x").alias("key"), F.lit("y").alias("part"))
    warc.write_archive(r, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a" / "headers")).select("part").distinct().count() > 5
    got = {x.record_id: (x.record_type, x.refers_to, x.payload_bytes) for x in warc.read_index(spark, str(tmp_path / "a")).collect()}
    assert got == {i: ("response", None, 3 if i == 198 else len(str(i))) if i % 2 or i == 198 else ("revisit", 198, 3) for i in range(200)}


def test_warc_damage_is_found(spark, tmp_path):
    r = spark.createDataFrame([(1, "u", "x")], "record_id long, target string, payload string")
    warc.write_archive(r, str(tmp_path / "a"))
    good = spark.read.parquet(str(tmp_path / "a" / "payloads"))
    for name, other in (("b", good.withColumn("payload", F.lit(b"y"))), ("d", good.withColumns({"payload": F.lit(b"y"), "key": F.lit(hashlib.sha256(b"y").hexdigest() + "-1")}))):
        other.write.parquet(str(tmp_path / name / "payloads"))
        headers = spark.read.parquet(str(tmp_path / "a" / "headers"))
        (headers if name == "b" else headers.withColumn("key", F.lit(hashlib.sha256(b"y").hexdigest() + "-1"))).write.parquet(str(tmp_path / name / "headers"))
        with pytest.raises(Exception, match="damaged|differs from its payload"):
            warc.read_index(spark, str(tmp_path / name)).collect()


def test_warc_writing_leaves_no_shuffle_files(spark, tmp_path):
    def files():
        blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return {n for i in range(blocks.length()) if re.fullmatch(r"shuffle_\d+_.*\.data", n := blocks.apply(i).name())}

    before, setting = files(), spark.conf.get(warc.CLEANUP, None)
    r = spark.range(300).select(F.col("id").alias("record_id"), F.lit("u").alias("target"), (F.col("id") % 200).cast("string").alias("payload"))
    warc.write_archive(r, str(tmp_path / "a"))
    end = time.time() + 10
    while files() - before and time.time() < end:  # Spark deletes them a moment later
        time.sleep(0.1)
    assert not files() - before and spark.conf.get(warc.CLEANUP, None) == setting
    assert warc.read_index(spark, str(tmp_path / "a")).where("record_type = 'revisit'").count() == 100


def test_warc_of_no_pages(spark, sf, tmp_path):
    for name in ("pages",):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert warc.op6_warc(spark, str(tmp_path)).count() == 0 and url_filters.op8_url_filters(spark, str(tmp_path)).count() == 0


# --- 7 -------------------------------------------------------------------------------------------------------------------
def check_spans(spark, pairs):
    got = suffix_dedup.with_spans(frame(spark, pairs)).mapInArrow(suffix_dedup.report, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").collect()
    want = H.repeated_bytes(pairs, 100)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == Counter((d, len((t or "").encode()), want[d, t][1], want[d, t][2], hashlib.sha256(want[d, t][0]).hexdigest()) for d, t in pairs)
    return sum(r.n_removed for r in got)


def test_suffix_brute_force(spark, docs):
    assert check_spans(spark, docs) > 0


def test_suffix_overlaps_periods_and_hot_phrases(spark, monkeypatch):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    p = " ".join(word() for _ in range(60))
    phrase = "a phrase of more than thirty-two bytes that stands everywhere"
    pairs = [(0, p), (1, "x" + p[10:250] + "y" + p[100:300]), (2, "q" * 350), (3, "é" * 120), (4, p[:99]), (5, p[:100]), (6, "z" * 40 + p[50:149] + "z" * 40)]
    pairs += [(100 + i, " ".join(word() for _ in range(8)) + phrase + " ".join(word() for _ in range(8))) for i in range(90)]
    assert check_spans(spark, pairs) > 0
    assert suffix_dedup.HOT_CLASSES < 90


def test_suffix_hot_anchors_make_few_rows(spark, monkeypatch):
    """Runs of a hot anchor go on in a few parts, not window by window; of keys that are hot even so, single windows are compared."""
    rng = np.random.default_rng(5)
    noise = lambda n: "".join(chr(97 + x) for x in rng.integers(0, 26, n))
    phrase, tails = noise(40), [noise(70) for _ in range(5)]
    data = (noise(100) + phrase + noise(100)).encode()
    runs = suffix_dedup.runs(data)
    status = suffix_dedup.squeeze(np.full(len(runs[0]), suffix_dedup.SPREAD, np.uint8))
    batch = pa.RecordBatch.from_pylist([{"_id": 1, "_t": 2, "text": data.decode(), "status": status}])
    rows = [r for b in suffix_dedup.gather(iter([batch])) for r in b.to_pylist()]
    assert len(rows) <= 4 * len(runs[0]) < len(data) // 4
    assert sorted(w for r in rows for w in range(r["at"], r["at"] + len(r["bytes"]) - suffix_dedup.LENGTH + 1)) == list(range(len(data) - suffix_dedup.LENGTH + 1))
    # every other phrase has one of a few surroundings on its right, of a length that leaves some windows equal
    pairs = [(i, noise(90) + phrase + (tails[i % 5][: 55 + i % 15] if i % 2 else "") + noise(90)) for i in range(160)]
    monkeypatch.setattr(suffix_dedup, "HOT_TOTAL", 10)
    plain = frame
    monkeypatch.setitem(globals(), "frame", lambda *x: plain(*x).coalesce(1))  # one chunk, where the anchor is hot
    assert len(pairs) > 2 * suffix_dedup.HOT_CLASSES and check_spans(spark, pairs) > 0


def test_suffix_awkward(spark):
    d = H.awkward(spark)
    check_spans(spark, [(r.doc_id, r.text) for r in d.collect() if r.doc_id != 7 and len(r.text or "") < 10_000])
    got = suffix_dedup.remove_repeats(d)
    assert got.columns == d.columns and got.count() == d.count()
    assert suffix_dedup.remove_repeats(H.empty(spark)).count() == 0


def brute_lpf(s):
    out = []
    for i in range(len(s)):
        k = 0
        while i + k < len(s) and k < 100 and s.find(s[i : i + k + 1]) < i:
            k += 1
        out.append(k)
    return out


def test_longest_previous_factor():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 50, 300):
        s = bytes(rng.integers(97, 99, n, np.uint8))
        assert suffix_dedup.longest_previous_factor(s).tolist() == brute_lpf(s)
    for s in (b"a" * 250, bytes(130), (b"ab" * 40 + b"c") * 4, bytes(range(200)) * 2):
        assert suffix_dedup.longest_previous_factor(s).tolist() == brute_lpf(s)


def test_smaller_positions():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 200):
        p, common = rng.permutation(n), rng.integers(0, 5, n)
        want = []
        for i in range(n):
            j, low = i - 1, 9
            while j >= 0 and p[j] > p[i]:
                j -= 1
            back = min(common[j + 1 : i + 1], default=0) if j >= 0 else 0
            j = i + 1
            while j < n and p[j] > p[i]:
                j += 1
            want.append(max(back, min(common[i + 1 : j + 1]) if j < n else 0))
        assert suffix_dedup.previous_factors(p, common).tolist() == want
        assert suffix_dedup.previous_factors(p, common, 3).tolist() == [w if w >= 3 else 0 for w in want]


def test_suffix_anchors_are_hot_over_all_chunks():
    """Classes are counted over all chunks, each of which has one; copies of a class from a later document go, from the same one they stay to be compared."""
    n = suffix_dedup.HOT_TOTAL
    for classes, want in ((n, suffix_dedup.COMPARE), (n + 1, suffix_dedup.SPREAD), (1, suffix_dedup.NOTHING)):
        c = np.append(np.arange(1, classes + 1), [1, 1]).astype(np.uint64)
        ids = np.append(np.arange(classes), [0, 500])
        (status,), hot = suffix_dedup.answer([np.full(len(c), 7, np.uint64), c, c, ids])
        assert status.tolist() == [want] * (classes + 1) + [suffix_dedup.REMOVED] and hot == (want == suffix_dedup.SPREAD)
    (status,), _ = suffix_dedup.answer([np.array([7, 7, 8], np.uint64), np.array([0, 3, 3], np.uint64), np.array([0, 3, 3], np.uint64), np.array([5, 6, 6])])
    assert status.tolist() == [suffix_dedup.SPREAD, suffix_dedup.SPREAD, suffix_dedup.NOTHING]


def test_suffix_hot_anchor_over_many_chunks(spark, monkeypatch):
    """A phrase in ever other surroundings; in two hops, with documents of one id and different texts among them."""
    from lodeworks.llm import exchange

    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    phrase = "a phrase of more than thirty-two bytes that stands everywhere"
    tails = [" ".join(word() for _ in range(8)) for _ in range(20)]
    pairs = [(i // 2 if i < 8 else i, " ".join(word() for _ in range(8)) + phrase + tails[i % 20]) for i in range(120)]
    want = check_spans(spark, pairs)
    monkeypatch.setattr(exchange, "DIRECT", 2)
    monkeypatch.setattr(suffix_dedup, "ranges_for", lambda keys: 10)
    assert check_spans(spark, pairs) == want > 0


# --- 8 -------------------------------------------------------------------------------------------------------------------
def test_url_rules_and_list(spark):
    urls = [None, "nonsense", "http://EXAMPLE.org/es/x?y#z", "http://a.example.org/en/1", "http://notexample.org/en/12", "http://x.com/de/", "http://x.com/fr", "ftp://x.com/fr/1", "http://org", "http://org/", "http://www.site.net:80/p/", "https://site.net/p.html?ref=q", "http://other.net/://org/"]
    p = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    listed = spark.createDataFrame([("site.net/p",), (None,)], "canon string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(p, url_filters.RULES, listed).collect()}
    assert got == {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("example.org", "/es/x", "example.org/es/", "block"), 3: ("a.example.org", "/en/1", "example.org/en/1", "block"), 4: ("notexample.org", "/en/12", "org/", "allow"),
        5: ("x.com", "/de/", "com/de/", "block"), 6: ("x.com", "/fr", None, "allow"), 7: ("x.com", "/fr/1", "com/fr/", "allow"), 8: ("org", "", None, "allow"), 9: ("org", "/", "org/", "allow"),
        10: ("www.site.net:80", "/p/", None, "block"), 11: ("site.net", "/p.html", None, "block"), 12: ("other.net", "/://org/", None, "allow"),
    }
    assert url_filters.judge(p.limit(0), url_filters.RULES, listed).count() == 0
    assert url_filters.judge(p, url_filters.RULES, listed.limit(0)).where("listed").count() == 0


def test_url_canonical_keeps_queries_and_traps_need_forms(spark):
    urls = {
        0: "http://a.net/x?page=2", 1: "https://www.a.net/x?utm_source=f&page=2#top", 2: "http://a.net/x", 3: "http://a.net/x?b=1&a=2", 4: "http://a.net/x/?a=2&b=1", 5: "http://a.net/y#f?q=1", 6: "https://a.net/y?ref=z",
        7: "http://m.b.net/z", 8: "http://b.net/z.html", 9: "http://c.net/#http://d.net/?q=1", 10: "http://long.net/" + "a/" * 500_000 + "?x=1",
    }
    found = url_filters.parsed(spark.createDataFrame(list(urls.items()), "page_id long, url string").withColumns({c: F.lit("v") for c in ("host", "canon", "rule")}), url_filters.RULES)
    canon = {r.page_id: r.canon for r in found.collect()}
    assert [canon[i] for i in (0, 1, 2, 3, 4, 5, 6, 7, 8, 9)] == ["a.net/x?page=2"] * 2 + ["a.net/x"] + ["a.net/x?a=2&b=1"] * 2 + ["a.net/y"] * 2 + ["b.net/z"] * 2 + ["c.net"] and len(canon[10]) > 10**6
    assert {r.canon for r in url_filters.traps(found).collect()} == {"a.net/x?a=2&b=1", "b.net/z"}
    got = {r.page_id for r in url_filters.judge_parsed(found, url_filters.traps(found)).where("verdict = 'block'").collect()}
    assert got == {3, 4, 7, 8}


def test_bloom_has_no_false_negatives_and_few_false_positives(spark):
    a, b = (spark.range(n, n + 4000).select(F.concat(F.lit("h/"), F.col("id").cast("string")).alias("canon")) for n in (0, 10**6))
    f = url_filters.bloom(a, 1000)
    assert url_filters.possible(a, f, 1000).count() == 4000
    assert url_filters.possible(b, f, 1000).count() < 400
    assert url_filters.listed_among(a.unionByName(b), a).count() == 4000


# --- 9 -------------------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def words():
    return piece_sampling.Words(piece_sampling.Pieces())


@pytest.fixture(scope="module")
def pieces(words):
    return words.pieces


def segmentations(pieces, text):
    """All of them, with their weights."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=piece_sampling.MODEL)
    known = {model.id_to_piece(int(i)): (int(i), float(w)) for i, w in zip(pieces.ids, pieces.weights, strict=True)}
    s = piece_sampling.MARK + text.replace(" ", piece_sampling.MARK)

    def go(i):
        if i == len(s):
            yield (), 1.0
        for n in range(1, min(16, len(s) - i) + 1):
            q = s[i : i + n]
            if q in known:
                yield from (((known[q][0], *r), known[q][1] * w) for r, w in go(i + n))
            elif n == 1:
                b = tuple(int(pieces.byte[x]) for x in q.encode())
                yield from (((*b, *r), pieces.byte_weight ** len(b) * w) for r, w in go(i + 1))

    found = list(go(0))
    total = sum(w for _, w in found)
    return {s: w / total for s, w in found}


def test_pieces_are_sampled_without_replacement(words, pieces):
    p, n = segmentations(pieces, "the an"), 6000
    got = piece_sampling.sample(["the an"] * n, list(range(n)), words, 3)
    ids = [[tuple(x[0].tolist()) for x in r] for r in got]
    assert all(len(set(x)) == 3 for x in ids) and all(r[0][2] > r[1][2] > r[2][2] for r in got)
    assert all(math.isclose(x[1], math.log(p[tuple(x[0].tolist())]), abs_tol=1e-5) for r in got[:200] for x in r)
    second = Counter()
    for f, a in p.items():
        for s, b in p.items():
            if s != f:
                second[s] += a * b / (1 - a)
    for place, want in ((0, p), (1, second)):
        seen = Counter(x[place] for x in ids)
        for s, q in want.items():
            assert abs(seen[s] / n - q) < 5 * math.sqrt(q * (1 - q) / n) + 1e-3
    mean = sum(len(s) * q for s, q in p.items())
    assert abs(np.mean([sum(len(x[0]) * math.exp(x[1]) / x[3] for x in r) for r in got]) - mean) < 0.01  # inclusion scores make sums unbiased


def test_pieces_of_tiny_probability_are_samples_too(words, pieces):
    """A text with as many segmentations as are asked for, or fewer, has all of them, however improbable."""
    texts = ["t", "é", "an", "x y"]
    for k in (2, 4, 9):
        for t, r in zip(texts, piece_sampling.sample(texts, list(range(len(texts))), words, k), strict=True):
            every = segmentations(pieces, t)
            ids = [tuple(x[0].tolist()) for x in r]
            assert len(set(ids)) == len(ids) == min(k, len(every)) and set(ids) <= set(every)
            assert all(math.isclose(x[1], math.log(every[i]), abs_tol=1e-5) for i, x in zip(ids, r, strict=True))


def test_pieces_query_has_the_segmentations(spark, sf, pieces):
    got = {r.doc_id: r for r in QUERIES["op9_piece_sampling"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        for x in got[r.doc_id].samples or ():
            assert len(x.ids) == x.n_tokens and pieces.decode(np.array(x.ids, np.int32)) == r.text.encode()
            assert hashlib.sha256(np.array(x.ids, "<i4").tobytes()).hexdigest() == x.ids_sha256


def test_pieces_round_trip_and_seed(words, pieces):
    texts = ["", "a", " a  b ", "x\n\ty▁z", "퟿日本語 😀 ñ\x00", H.BASE * 30, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 40]
    got = piece_sampling.sample(texts, [3] * len(texts), words)
    for t, r in zip(texts, got, strict=True):
        assert r and all(pieces.decode(x[0]) == t.encode() for x in r) and len({x[0].tobytes() for x in r}) == len(r)
    alone = piece_sampling.sample([texts[5]], [3], words)[0]
    assert all((a[0] == b[0]).all() and math.isclose(a[2], b[2]) for a, b in zip(alone, got[5], strict=True))
    assert len(got[0]) == 1 and got[0][0][3] == 1.0


def test_pieces_search_is_complete_when_values_are_low(words, monkeypatch):
    texts = [H.BASE * 5, "the an"]
    want = piece_sampling.sample(texts, [1, 2], words, 3)
    monkeypatch.setattr(piece_sampling.Search, "FLOOR", -0.5)
    monkeypatch.setattr(piece_sampling.Search, "SPAN", 37.0)
    got = piece_sampling.sample(texts, [1, 2], words, 3)
    assert [[x[0].tolist() for x in r] for r in got] == [[x[0].tolist() for x in r] for r in want]


def test_pieces_of_kept_words(pieces):
    """Kept lattices change no sample."""
    texts = [H.BASE, "the cat sat on the mat " * 5, "other words of one batch"]
    fresh = [piece_sampling.sample([t], [i], piece_sampling.Words(pieces))[0] for i, t in enumerate(texts)]
    words = piece_sampling.Words(pieces)
    for _ in range(words.LEARN + 2):
        got = piece_sampling.sample(texts, [0, 1, 2], words)
        for a, b in zip(got, fresh, strict=True):
            assert [x[0].tolist() for x in a] == [x[0].tolist() for x in b]
    assert words.kept is not None and "▁the" in words.ids and "▁other" in words.ids


def test_pieces_lattice_asks_only_where_a_piece_goes_on(pieces, monkeypatch):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=piece_sampling.MODEL)
    known = {model.id_to_piece(int(i)): int(i) for i in pieces.ids}
    begun = {p[:n] for p in known for n in range(1, len(p))}
    words = ["▁international", "▁qxzjvkwpqxzjvkwpq", "日本語x", "\n", "a" * 300, "▁the", "▁Wissenschaft"]
    asked, find = [], piece_sampling.Pieces.find
    monkeypatch.setattr(piece_sampling.Pieces, "find", lambda self, keys: asked.append(len(keys)) or find(self, keys))
    lattice = piece_sampling.Lattice(words, pieces)
    assert sum(asked) == sum(n == 1 or w[i : i + n - 1] in begun for w in words for i in range(len(w)) for n in range(1, min(pieces.longest, len(w) - i) + 1))
    for w, node in zip(words, lattice.firsts, strict=True):
        for i in range(len(w)):
            want = [known.get(w[i : i + n], -1 if n == 1 else -2) if i + n <= len(w) else -2 for n in range(1, pieces.longest + 1)]
            assert lattice.piece[node].tolist() == want and ((lattice.step[node] > 0) == (lattice.piece[node] > -2)).all() and math.isclose(lattice.step[node].sum(), 1, abs_tol=1e-5)
            node = lattice.on(node, 1) if i + 1 < len(w) else node


def test_pieces_parts_of_texts():
    texts = ["", "a", " a  b ", "x\n\ty▁z", "\n\n", " ", "퟿日本語 😀 ñ\x00\n a", "ÿ \n ÿ", "a"]
    distinct, part, counts = piece_sampling.parts_of(texts)
    want = [re.findall("\n|▁[^▁\n]*|[^▁\n]+", "▁" + t.replace("▁", piece_sampling.LITERAL).replace(" ", "▁")) if t else [] for t in texts]
    assert [distinct[i] for i in part] == [w for x in want for w in x] and counts.tolist() == list(map(len, want)) and len(set(distinct)) == len(distinct)
    assert all(len(x) == 0 for x in piece_sampling.parts_of([])) and piece_sampling.parts_of(["", ""])[2].tolist() == [0, 0]


def test_pieces_awkward(spark):
    got = piece_sampling.sample_documents(H.awkward(spark)).collect()
    assert len(got) == 13 and [r.samples for r in got if r.doc_id == 2] == [None]
    assert all(x.round_trip and 0 < x.inclusion <= 1 or x.inclusion == 0 for r in got for x in r.samples or ())
    assert piece_sampling.sample_documents(H.empty(spark)).count() == 0


# --- 10 ------------------------------------------------------------------------------------------------------------------
def base_places(text):
    w, found = H.plain_words(text), []
    for phrase, label in license_scan.PHRASES.items():
        q = phrase.split()
        found += [(i, label) for i in range(len(w) - len(q) + 1) if w[i : i + len(q)] == q]
    return len(w), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found}))


def test_license_base(spark, docs):
    extra = [(10**6, "MIT\nLicense mit license; CC-BY cc by"), (10**6 + 1, None), (10**6 + 2, "gnu general gnu general public license")]
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_scan.scan(frame(spark, [*docs, *extra])).collect()}
    assert got == {d: base_places(t) for d, t in [*docs, *extra]}


def test_license_automaton_gives_matching_statistics():
    rng = np.random.default_rng(5)
    temps = [rng.integers(1, 5, 30).tolist() for _ in range(4)]
    a = license_scan.Automaton(temps)
    text = rng.integers(0, 5, 400).tolist()
    subs = {tuple(t[i:j]) for t in temps for i in range(30) for j in range(i + 1, 31)}
    for i, (length, state) in enumerate(a.statistics(text)):
        want = max((n for n in range(1, min(30, i + 1) + 1) if tuple(text[i + 1 - n : i + 1]) in subs), default=0)
        assert length == want
        for which, end in a.ends[state].items() if length else ():
            assert temps[which][end - length : end] == text[i + 1 - length : i + 1]


def test_license_spans():
    s = license_scan.Scanner()
    mit = next(t for label, t in license_scan.TEMPLATES if label == "mit" and "hereby" in t)
    words = mit.split()
    broken = " ".join(["intro", *words[:12], "inserted", "words", *words[12:], "outro"])
    _, n_base, _, _, base, labels, score, spans = s.scan(broken.encode())
    assert (n_base, base, labels) == (0, "", "mit") and score > 0.9 and spans[0]["start"] == 1 and spans[0]["end"] == len(words) + 3
    assert s.scan(b"")[:2] == (0, 0) and s.scan(" ".join(words[:7]).encode())[5] == ""


def test_license_needs_its_own_words():
    """Shared wording gives no label: each wording is labelled as itself alone, no beginning of one as another."""
    s = license_scan.Scanner()
    named = lambda text: {f["label"] for f in s.scan(text.encode())[7]}
    for label, text in license_scan.TEMPLATES:
        assert named(text) == {label}
        words = text.split()
        for n in range(len(words) // 2, len(words) - 3):
            assert named(" ".join(words[:n]) + " X licence") <= ({label} if n >= 0.9 * len(words) else set())
    for text in (
        "This work is licensed under the X licence", "This work is licensed under the Apache License", "Licensed under the Apache License, Version 1.1",
        "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    ):
        assert named(text) == set()
    for label, text in license_scan.short_wordings():
        assert named(f"x {text} y") == {label}
        short = text.rsplit(" ", 1)[0]
        assert any(short.endswith(t) for _, t in license_scan.short_wordings()) or not named(short + " other words")
    for label, text in (("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."), ("apache-2.0", "Code is made available under the Apache-2.0 license"), ("cc-by-nc-sa-4.0", "Text is available under CC BY-NC-SA 4.0."), ("agpl-3.0", "SPDX-License-Identifier: AGPL-3.0-only")):
        assert named(text) == {label}
    notice = dict(license_scan.TEMPLATES)["gpl-3.0-or-later"]
    assert named(notice.replace("version 3", "version 2")) == {"gpl-2.0-or-later"}
    assert named(notice.replace("GNU General", "GNU Affero General")) == {"agpl-3.0-or-later"}


def test_license_whole_texts():
    """Each whole text, under another title and without its last tenth, is labelled as itself; the notices in it aren't labelled."""
    s = license_scan.Scanner()
    texts = license_scan.whole_texts()
    assert {"apache-2.0", "gpl-2.0", "gpl-3.0", "lgpl-2.1", "lgpl-3.0", "epl-1.0", "cc0-1.0", "zlib", "bsl-1.0"} <= {label for label, _ in texts}
    for label, text in texts:
        assert {f["label"] for f in s.scan(text.encode())[7]} == {label}
        words = text.split()
        assert label in s.scan(" ".join(["intro", *words[: len(words) * 9 // 10], "outro"]).encode())[5].split(",")
    gpl = dict(texts)["gpl-3.0"]
    affero = gpl.replace("13. Use with the GNU Affero General Public License.", "13. Remote Network Interaction; Use with the GNU General Public License.")
    assert affero != gpl and "gpl-3.0" not in {f["label"] for f in s.scan(affero.encode())[7]}


def brute_license(text, templates):
    """Labels and score by substring search: for each template the longest match that ends at each word of the file, seeds where it stops growing, and the best chain of them."""
    L = license_scan
    words = H.plain_words(text)
    known = {w for _, t in templates for w in H.plain_words(t)}
    has = lambda seq, part: any(seq[i : i + len(part)] == part for i in range(len(seq) - len(part) + 1))
    base = {label for phrase, label in L.PHRASES.items() if has(words, phrase.split())}
    best, found = 0.0, []
    least = min([L.MIN_MATCH, *(len(H.plain_words(t)) for _, t in templates)])
    for label, template in templates:
        t = H.plain_words(template)
        joined_ = " " + " ".join(t) + " "
        lengths = []
        for i in range(len(words)):
            n = 0
            while n <= i and words[i - n] in known and f" {' '.join(words[i - n : i + 1])} " in joined_:
                n += 1
            lengths.append(n if n >= least else 0)
        seeds = []
        for i, n in enumerate(lengths):
            after = lengths[i + 1] if i + 1 < len(words) else 0
            if n and n >= after and n >= min(L.MIN_MATCH, len(t)):
                part = words[i + 1 - n : i + 1]
                at = next(k for k in range(len(t)) if t[k : k + n] == part)
                seeds.append((at, i + 1 - n, n))
        seeds = sorted(set(seeds), key=lambda s: (s[1], s[0]))
        chains = []
        for at, place, n in seeds:
            before = [(c + n, f) for (a, p, m), (c, f) in zip(seeds, chains, strict=False) if a + m <= at and p + m <= place and place - (p + m) <= len(t)]
            chains.append(max([(n, place), *before], key=lambda x: x[0]))
        if not chains:
            continue
        covered, first, end = max(((c, f, p + n) for (c, f), (_, p, n) in zip(chains, seeds, strict=True)), key=lambda x: (x[0], -x[1], x[2]))
        inside = words[first:end]
        needs = [has(inside, H.plain_words(p)) for p in L.NEEDS.get(label, [])]
        if len(t) >= L.LONG and needs and not (any if label in L.ANY_OF else all)(needs) or len(t) >= L.LONG and any(has(words, H.plain_words(p)) for p in L.UNLESS.get(label, [])):
            continue
        share = covered / len(t)
        best = max(best, share)
        if share >= next(x for n, x in L.COVERAGES if len(t) >= n):
            found.append((label, first, end, len(t)))
    whole = [(f, e) for _, f, e, n in found if n >= L.COVERAGES[0][0]]
    labels = base | {label for label, f, e, n in found if n >= L.COVERAGES[0][0] or not any(a <= f and e <= b for a, b in whole)}
    return ",".join(sorted(labels)), max(best, L.PHRASE_SCORE if base else 0.0)


def test_license_brute_force(spark, docs):
    """Whole wordings, cut, mixed and broken ones, in other texts, and the sample documents."""
    import random

    rng = random.Random(7)
    texts = dict(license_scan.whole_texts())
    templates = [*license_scan.short_wordings()[::3], *license_scan.TEMPLATES, *((k, texts[k]) for k in ("mit", "bsd-2-clause", "bsd-3-clause", "zlib", "bsl-1.0"))]
    made = []
    for i in range(120):
        out = ["intro", "words"]
        for _ in range(rng.randint(1, 3)):
            w = rng.choice(templates)[1].split()
            a = rng.choice([0, 0, 0, rng.randrange(len(w))])
            w = w[a : rng.choice([len(w), len(w), rng.randrange(a, len(w)) + 1])]
            for _ in range(rng.choice([0, 0, 1, 3])):
                w.insert(rng.randrange(len(w) + 1), rng.choice(["broken", "the", "License"]))
            out += [*w, *["other"] * rng.choice([0, 2, 50])]
        made.append((10**6 + i, " ".join(out)))
    s = license_scan.Scanner(templates)
    labels = set()
    for _, text in [*made, *((d, t) for d, t in docs if t and ("licen" in t.lower() or d < 20))]:
        got = s.scan(text.encode())
        want = brute_license(text, templates)
        assert got[5] == want[0] and math.isclose(got[6], want[1]), text
        labels |= {got[5]}
    assert len(labels) > 20


def test_license_matches_are_of_each_template():
    """A longer match in one template doesn't hide a whole other one."""
    s = license_scan.Scanner([("long", "zero one two three four five six seven eight"), ("short", "one two three four five six seven eight")])
    assert [f["label"] for f in s.scan(b"x zero one two three four five six seven eight y")[7]] == ["long", "short"]


def test_license_awkward(spark):
    got = license_scan.scan(H.awkward(spark)).collect()
    assert len(got) == 13 and {r.base_labels for r in got if r.doc_id == 9} == {"cc-by,gpl,mit"}
    assert license_scan.scan(H.empty(spark)).count() == 0
