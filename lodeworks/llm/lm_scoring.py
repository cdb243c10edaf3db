"""LM scoring by deleted interpolation.

P(v | u) = a[b] c(u, v) / c(u) + b[b] c(v) / N + c[b] / (V + 1), where b is the bucket of the context u: the bit length of c(u). The weights of a
bucket add up to 1 and are learned by expectation-maximisation on held-out counts: the training documents of fold EM_FOLD are deleted from the counts
for that, and their bigrams are the events; where that fold is empty, the least training fold that isn't takes its place. Scores then use the counts of all training documents.

All counts are exact, over all training documents: tokens are packed by chunk into a written table, and two exchanges (see exchange.py) bring each chunk
the counts of its own words and bigrams. Nothing of the corpus is broadcast or collected but the table of (bucket, ratio, ratio) bins of the EM, whose
size is bounded by the grid (GRID bins an octave).

Documents whose crc32(id as text) mod 10 is 0 are held out from all learning.

Defined results: a null or empty text is one end token; a null id counts as held out; repeated rows all count and are scored each; without
training documents in two folds there is nothing to learn from and every weight is the uniform one's; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, materialize, read, rows_of, utf8
from .exchange import ASKED, ASKED_SCHEMA, CHUNK_BYTES, Exchange, adding, batch_of, expand, expand_sorted, joined, ranges_for, small_batches, squeeze, squeeze_sorted
from .minhash_dedup import mix

FOLDS, HELD_OUT, EM_FOLD = 10, 0, 1
GRID, EM_STEPS = 4, 60
END, BEGIN = np.uint64(xxhash.xxh3_64_intdigest(b"\n")), np.uint64(xxhash.xxh3_64_intdigest(b" "))
_CHUNKS = "chunk string, em boolean, docs array<long>, lengths array<int>, held array<boolean>, tokens binary, vocabulary binary"
_FIELDS = pa.schema(
    [("chunk", pa.string()), ("em", pa.bool_()), ("docs", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("held", pa.list_(pa.bool_())), ("tokens", pa.binary()), ("vocabulary", pa.binary())]
)


class _Chunk:
    def __init__(self, em: bool) -> None:
        self.em, self.docs, self.held, self.parts, self.bytes = em, [], [], [], 0

    def add(self, doc_id: int | None, held: bool, hashes: np.ndarray, size: int) -> None:
        self.docs.append(doc_id)
        self.held.append(held)
        self.parts.append(hashes)
        self.bytes += size

    def packed(self) -> pa.RecordBatch:
        vocabulary, tokens = np.unique(np.concatenate(self.parts), return_inverse=True)
        row = [uuid.uuid4().hex, self.em, self.docs, [len(p) for p in self.parts], self.held, squeeze(tokens.astype(np.uint32)), squeeze_sorted(vocabulary)]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _FIELDS.types, strict=True)], schema=_FIELDS)


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of token numbers. Documents of the EM fold have chunks of their own."""
    hashes, open_ = WordHashes(), {em: _Chunk(em) for em in (False, True)}
    for doc_id, fold, text in rows_of(batches, "doc_id", "fold", "text"):
        data = utf8(text)
        words = data.lower().split()
        h = np.empty(len(words) + 1, np.uint64)
        h[:-1] = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
        h[-1] = END
        em = fold == EM_FOLD
        open_[em].add(doc_id, fold == HELD_OUT, h, len(data) + 100)
        if open_[em].bytes >= CHUNK_BYTES:
            yield open_[em].packed()
            open_[em] = _Chunk(em)
    yield from (c.packed() for c in open_.values() if c.docs)


def opened(lengths: list[int], tokens: bytes, vocabulary: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Vocabulary, tokens, contexts (the vocabulary's size stands for the beginning) and the documents' first tokens."""
    words, t = expand_sorted(vocabulary), expand(tokens, np.uint32)
    first = np.cumsum([0, *lengths[:-1]])
    context = np.empty(len(t), np.uint32)
    context[1:] = t[:-1]
    context[first] = len(words)
    return words, t, context, first


def bigram_keys(words: np.ndarray, t: np.ndarray, context: np.ndarray) -> np.ndarray:
    h = np.append(words, BEGIN)
    return mix(mix(h)[context] + h[t])


def weights_of(em: bool, held: list[bool], lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For each token, whether it counts outside and inside the EM fold."""
    trained = np.repeat(~np.array(held, bool), lengths)
    return (np.zeros_like(trained), trained) if em else (trained, np.zeros_like(trained))


WIRE, ANSWER, REPLIES, COMBINE = adding(2)


def counting(ranges: int) -> Exchange:
    """Keys are hashes, so they are their own routes; sorted keys are in the order of ranges, and so are the replies."""
    return Exchange(WIRE, lambda columns: columns[0], ANSWER, REPLIES, ranges, COMBINE)


def asker(exchange: Exchange, bigrams: bool):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, em, lengths, held, tokens, vocabulary in rows_of(batches, "chunk", "em", "lengths", "held", "tokens", "vocabulary", at_once=1):
            words, t, context, _ = opened(lengths, tokens, vocabulary)
            keys, where = np.unique(bigram_keys(words, t, context), return_inverse=True) if bigrams else (words, t)
            numbers = [np.bincount(where[w], minlength=len(keys)).astype(np.uint64) for w in weights_of(em, held, lengths)]
            yield batch_of(exchange.ask(chunk, [keys, *numbers])[0], ASKED_SCHEMA)

    return ask


def bins(ratio: np.ndarray) -> np.ndarray:
    """Bins of GRID an octave; -10000 for 0."""
    return np.where(ratio > 0, np.round(GRID * np.log2(np.maximum(ratio, 1e-300))), -10000).astype(np.int32)


def bucket(count: np.ndarray) -> np.ndarray:
    return np.frexp(count.astype(np.float64))[1]


_JOINED = ["chunk", "docs", "lengths", "held", "tokens", "vocabulary", "u", "b"]


def estimates(lengths: list[int], tokens: bytes, vocabulary: bytes, u: list[list[bytes]], b: list[list[bytes]], all_: bool, begins: int) -> tuple:
    """Per token: c(u, v), c(u), c(v); and the documents' first tokens. all_: with the EM fold's counts."""
    words, t, context, first = opened(lengths, tokens, vocabulary)
    add = lambda x: (x[0] + x[1] if all_ else x[0]).astype(np.float64)
    single = np.append(add(joined(u, REPLIES)), begins)
    _, where = np.unique(bigram_keys(words, t, context), return_inverse=True)
    return add(joined(b, REPLIES))[where], single[context], single[t], first


def em_events(n: int, v: int, begins: int):
    def events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lengths, tokens, vocabulary, u, b in rows_of(batches, "lengths", "tokens", "vocabulary", "u", "b", at_once=1):
            c2, cu, c1, _ = estimates(lengths, tokens, vocabulary, u, b, False, begins)
            p2 = np.divide(c2, cu, out=np.zeros_like(c2), where=cu > 0)
            code = np.stack([bucket(cu), bins(p2 * (v + 1)), bins(c1 / max(n, 1) * (v + 1))])
            kinds, counts = np.unique(code, axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([*(pa.array(k, pa.int32()) for k in kinds), pa.array(counts, pa.int64())], names=["bucket", "r2", "r1", "n"])

    return events


def learn(events: np.ndarray) -> np.ndarray:
    """(64, 3) weights of bigram, word and uniform, by bucket; events: rows of bucket, r2, r1, n."""
    weights = np.tile([0.0, 0.0, 1.0], (64, 1))
    value = lambda q: np.where(q <= -10000, 0.0, np.exp2(q / GRID))
    for b in np.unique(events[:, 0]) if len(events) else ():
        e = events[events[:, 0] == b]
        p = np.stack([value(e[:, 1]), value(e[:, 2]), np.ones(len(e))], axis=1)
        w = np.full(3, 1 / 3) if b else np.array([0.0, 0.5, 0.5])
        for _ in range(EM_STEPS):
            share = p * w
            share *= (e[:, 3] / share.sum(axis=1))[:, None]
            w = share.sum(axis=0) / share.sum()
        # no weight but that of an unseen context's bigram vanishes, so that any text has a probability
        weights[int(b)] = (w + 1e-6 * (np.arange(3) > 0)) / (1 + 2e-6)
    seen = np.unique(events[:, 0]).astype(int) if len(events) else np.array([], int)
    for b in range(64):  # a bucket without events takes the nearest one's weights; without context the bigram has none
        if len(seen) and b not in seen:
            weights[b] = weights[seen[np.abs(seen - b).argmin()]]
    weights[0, 1:] += weights[0, 0] / 2
    weights[0, 0] = 0
    return weights


def scorer(weights: np.ndarray, n: int, v: int, begins: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, lengths, held, tokens, vocabulary, u, b in rows_of(batches, "docs", "lengths", "held", "tokens", "vocabulary", "u", "b", at_once=1):
            c2, cu, c1, first = estimates(lengths, tokens, vocabulary, u, b, True, begins)
            w = weights[bucket(cu)]
            p = w[:, 0] * np.divide(c2, cu, out=np.zeros_like(c2), where=cu > 0) + w[:, 1] * c1 / max(n, 1) + w[:, 2] / (v + 1)
            total = lambda x: np.add.reduceat(x, first)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(docs, pa.int64()),
                    pa.array(held, pa.bool_()),
                    pa.array(lengths, pa.int64()),
                    pa.array(total((c1 > 0).astype(np.int64)), pa.int64()),
                    pa.array([n] * len(docs), pa.int64()),
                    pa.array(total(np.log10((c1 + 0.1) / (n + 0.1 * (v + 1)))), pa.float64()),
                    pa.array(total(np.log10(p)), pa.float64()),
                ],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return score


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of docs."""
    with small_batches(docs):
        return _scored(docs)


def _scored(docs: DataFrame) -> DataFrame:
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS, F.lit(HELD_OUT)).cast("int")
    folds = set(docs.agg(F.collect_set(fold)).first()[0])
    if EM_FOLD not in folds and len(training := sorted(folds - {HELD_OUT})) > 1:
        fold = F.when(fold == training[0], EM_FOLD).otherwise(fold)
    chunks = materialize(docs.select("doc_id", fold.alias("fold"), "text").mapInArrow(pack, _CHUNKS), "chunks")
    askers, tokens = chunks.agg(F.count("*"), F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n)), F.lit(0))).first()
    exchange = counting(ranges_for(tokens / 2))  # a chunk has about a distinct bigram for two tokens
    singles, v = exchange.run(chunks.mapInArrow(asker(exchange, False), ASKED), askers, "word_counts")
    pairs, _ = exchange.run(chunks.mapInArrow(asker(exchange, True), ASKED), askers, "bigram_counts")
    trained = chunks.select("em", F.explode(F.arrays_zip("lengths", "held")).alias("d")).where("not d.held")
    sums = trained.agg(*(F.coalesce(x, F.lit(0)) for e in ("not em", "em") for x in (F.sum(F.when(F.expr(e), F.col("d.lengths"))), F.count_if(F.expr(e))))).first()
    told = lambda df, name: df.select(F.col("asker").alias("chunk"), F.col("replies").alias(name))
    ready = lambda part: part.join(told(singles, "u"), "chunk", "left").join(told(pairs, "b"), "chunk", "left")
    events = ready(chunks.where("em")).mapInArrow(em_events(sums[0], v, sums[1]), "bucket int, r2 int, r1 int, n long")
    kinds = events.groupBy("bucket", "r2", "r1").agg(F.sum("n").alias("n")).toPandas().to_numpy(np.float64)  # bounded by the grid
    scored = scorer(learn(kinds), sums[0] + sums[2], v, sums[1] + sums[3])
    done = ready(chunks).mapInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return materialize(done, "scores")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents"))
