"""SentencePiece encoding and decoding with sampled segmentations: Gumbel top-k without replacement.

A text's segmentations are the paths of its piece lattice; a path has probability proportional to the product of its pieces' weights, 1 / (rank + SHIFT) ** alpha
by the piece's rank in the model (a merge model's scores are ranks). The k segmentations with the greatest Gumbel-perturbed log probabilities are a sample
without replacement. A perturbed A* search finds them from the top down: a set of paths that share a prefix has the maximum of its paths'
perturbed values, which is a Gumbel variable at the set's log mass; the best set is split into the path that its maximum follows and, at each node
of that path, the paths that leave it there, with truncated Gumbel values. Sets wait with their values; the next best one gives the next segmentation.
The inclusion score of a sample is its probability to be over the (k+1)-th value: 1 - exp(-exp(log p - kappa)).

Texts are searched many at once by array operations; the lattice is built for each distinct word of a batch. Random numbers are a hash of seed, row key,
path and place in the text, so a row's samples don't depend on partitions or batches.

Spaces become the model's word mark, and one is put in front; characters without a piece, and a literal word mark, are spelled in bytes. Decoding
gives back the exact text. Pieces of several word marks (which the model never makes of itself) aren't used, so words are separate parts of the lattice.

Defined results: null texts have no sample; the empty text has the empty segmentation; a text with fewer than k segmentations has all of them, with inclusion 1; repeated
rows have equal samples, null keys one of their own; an empty table gives an empty result. A task holds BATCH_CHARS characters at once, or one longer text.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

from .common import read, rows_of

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES, ALPHA, SHIFT, SEED = 2, 1.0, 10.0, 9
BATCH_CHARS = 250_000
MARK, LITERAL = "▁", "\ud801"
U64 = np.uint64
GOLD, MUL = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9)
TABLE_BITS = 20
LEAST = float(np.finfo(np.float32).tiny)
#: Steps of more characters are rare; only nodes that have one are worked out to a lattice's full width.
NEAR = 8


def scramble(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(30))
    x *= MUL
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Pieces:
    """The model's pieces, found by a rolling hash of code points."""

    def __init__(self, path: str | bytes = MODEL, alpha: float = ALPHA) -> None:
        """path: of the model's file, or what it holds."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(**({"model_proto": path} if isinstance(path, bytes) else {"model_file": path}))
        n = model.get_piece_size()
        self.byte = np.zeros(256, np.int32)
        self.bytes = [b""] * n
        found: list[tuple[str, int, float]] = []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.bytes[i] = bytes([int(piece[3:5], 16)])
            elif not model.is_control(i) and not model.is_unknown(i) and MARK not in piece[1:]:
                self.bytes[i] = piece.replace(MARK, " ").encode()
                found.append((piece, i, -model.get_score(i)))
        self.id_type = np.int16 if n < 2**15 else np.int32
        self.longest = max(len(p) for p, _, _ in found)
        self.ids = np.array([i for _, i, _ in found], np.int32)
        self.weights = (1 / (np.array([r for _, _, r in found]) + SHIFT)) ** alpha
        self.byte_weight = float((1 / (n + SHIFT)) ** alpha)
        # what pieces begin with has a place too, behind the pieces', so that a search can end where no piece goes on
        begun = {p[:l] for p, _, _ in found for l in range(1, len(p))}
        strings = [p for p, _, _ in found]
        strings += sorted(begun.difference(strings))
        self.goes_on = np.array([p in begun for p in strings])
        self.keys = np.array([self._hash(p) for p in strings], np.uint64)
        assert len(set(self.keys.tolist())) == len(strings)
        # tables of places; each takes what collides in those before
        self.tables = [np.zeros(1 << TABLE_BITS, np.int32) for _ in range(3)]
        self.shifts = [U64(64 - TABLE_BITS), U64(24), U64(4)]
        over = np.arange(len(self.keys))
        for table, shift in zip(self.tables, self.shifts, strict=True):
            slots = (self.keys[over] * MUL >> shift & U64((1 << TABLE_BITS) - 1)).astype(np.int64)
            firsts = np.unique(slots, return_index=True)[1]
            table[slots[firsts]] = over[firsts] + 1
            over = np.delete(over, firsts)
        self.rest = dict(zip(self.keys[over].tolist(), over.tolist(), strict=True))
        self.rest_keys = np.array(sorted(self.rest), np.uint64)
        self.texts = np.array(self.bytes, object)

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = ((h + ord(c) + 1) * int(GOLD)) % 2**64
            h ^= h >> 29
        return h

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are pieces or what pieces begin with, and their places. Those among ids and weights are pieces."""
        hits, places, ask = [], [], None
        for table, shift in zip(self.tables, self.shifts, strict=True):
            # the next table has only what has another's slot in this one
            mixed = (keys if ask is None else keys[ask]) * MUL
            mixed >>= shift
            mixed &= U64((1 << TABLE_BITS) - 1)
            j = table.take(mixed.view(np.int64))
            hit = np.flatnonzero(j)
            j = j[hit] - 1
            hit = hit if ask is None else ask[hit]
            same = self.keys[j] == keys[hit]
            hits.append(hit[same])
            places.append(j[same])
            ask = hit[~same]
        if len(self.rest_keys):
            hits.append(np.flatnonzero(np.isin(keys, self.rest_keys)))
            places.append(np.array([self.rest[int(k)] for k in keys[hits[-1]]], np.int64))
        return np.concatenate(hits), np.concatenate(places)

    def decode(self, ids: np.ndarray) -> bytes:
        """The UTF-8 text of piece ids, without the space in front."""
        return b"".join(self.texts.take(ids).tolist())[1:]


class Lattice:
    """Lattices of distinct words, one node per character. For a node, step[node, l - 1] is the probability that a random path goes on with l characters, given that it
    gets there, and piece[node, l - 1] the piece's id, or -1 for a character in bytes. rest[node] is the probability of all steps but the likeliest, which may be far
    under the rounding of that one's; no step that there is rounds to 0.

    Nodes stand by the number of characters left, the longest words first, so that the nodes of one backward step are a slice, and so are those
    with l characters left or more."""

    AT_ONCE = 8192

    def __init__(self, words: list[str], pieces: Pieces) -> None:
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-self.length, kind="stable")
        self.rank = np.empty(len(words), np.int64)
        self.rank[order] = np.arange(len(words))
        longest = int(self.length.max(initial=0))
        live = np.searchsorted(-self.length[order], -np.arange(longest + 1), side="right")  # words with d characters or more
        live[:1] = 0
        self.start = np.append(0, np.cumsum(live))  # of the nodes with d characters left
        n, top = int(self.start[-1]), pieces.longest
        text = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        left = np.repeat(self.length, self.length) - np.arange(len(text)) + np.repeat(np.cumsum(self.length) - self.length, self.length)
        spot = self.start[left] + np.repeat(self.rank, self.length)
        self.code, self.left, self.word = np.empty(n, np.uint32), np.empty(n, np.int64), np.empty(n, np.int64)
        self.code[spot], self.left[spot], self.word[spot] = text, left, np.repeat(self.rank, self.length)
        piece, weight = np.full((top, n), -2, pieces.id_type), np.zeros((top, n), np.float32)  # by length while they are made
        following = self.start[self.left - 1] + self.word
        far = np.zeros(n, bool)
        node = at = np.arange(n)
        h = np.zeros(n, np.uint64)
        for l in range(1, min(top, longest) + 1):
            h = (h + self.code[at] + U64(1)) * GOLD
            h ^= h >> U64(29)
            hit, j = pieces.find(h)
            whole = j < len(pieces.ids)
            ends, j_ = node[hit[whole]], j[whole]
            piece[l - 1, ends] = pieces.ids[j_]
            weight[l - 1, ends] = pieces.weights[j_]
            if l > NEAR:
                far[ends] = True
            hit = hit[pieces.goes_on[j]]
            hit = hit[self.left[at[hit]] > 1]
            node, at, h = node[hit], following[at[hit]], h[hit]
        spelled = np.flatnonzero(piece[0] == -2)
        self.size = 1 + (self.code >= 0x80).astype(np.int64) + (self.code >= 0x800) + (self.code >= 0x10000)
        piece[0, spelled] = -1
        weight[0, spelled] = pieces.byte_weight ** self.size[spelled].astype(np.float64)
        self.piece = np.ascontiguousarray(piece.T)
        # backward, all words at once: ratio[j, w] is the mass of paths from j characters on over that from here
        ratio = np.zeros((top + 1, len(words)))
        ratio[0] = 1
        share, wider = np.zeros((min(NEAR, top), n)), []
        for d in range(1, longest + 1):
            a, b, m, wide = int(self.start[d]), int(self.start[d + 1]), int(live[d]), min(d, top)
            near = min(wide, NEAR)
            some = np.multiply(weight[:near, a:b], ratio[:near, :m], out=share[:near, a:b])
            total = self._sum(some)
            if wide > near and len(more := np.flatnonzero(far[a:b])):
                whole = np.zeros((top, len(more)))
                whole[:wide] = weight[:wide, a + more] * ratio[:wide, more]
                total[more] = self._sum(whole)
                wider.append((a + more, whole / total[more]))
            some /= total
            ratio[1 : wide + 1, :m] = ratio[:wide, :m] / total
            ratio[0, :m] = 1
        self.step, self.reach, self.rest = np.zeros((n, top), np.float32), np.empty((n, top), np.float32), np.empty(n, np.float32)
        for a in range(0, n, self.AT_ONCE):
            self._settle(slice(a, a + self.AT_ONCE), share[:, a : a + self.AT_ONCE])
        for rows, whole in wider:
            self._settle(rows, whole)
        self.reach[: self.start[min(longest + 1, top)], -1] = 1  # beyond a word's end, where a rounded number may lead
        self.row = self.left  # where start has the nodes with as many characters left
        self.firsts = self.start[self.length] + self.rank

    @staticmethod
    def _sum(x: np.ndarray) -> np.ndarray:
        """The sum of rows."""
        if len(x) < 8:
            return x.sum(axis=0)
        x = [x[i] + x[i + 8] for i in range(8)] if len(x) == 16 else [*x[:8], *x[8:]]
        total = ((x[0] + x[1]) + (x[2] + x[3])) + ((x[4] + x[5]) + (x[6] + x[7]))
        for more in x[8:]:
            total += more
        return total

    def _settle(self, nodes: slice | np.ndarray, share: np.ndarray) -> None:
        """Fills in step, reach and rest of nodes from the probabilities of their first steps; all others are 0."""
        low = share < LEAST
        low &= share > 0
        if low.any():
            share[low] = LEAST
        reach = np.empty((share.shape[1], self.reach.shape[1]), np.float32)
        self.step[nodes, : len(share)] = share.T
        total, top, greatest = np.zeros(share.shape[1], np.float32), share.max(axis=0), np.zeros(share.shape[1], np.int8)
        for i, column in enumerate(share):
            total += column.astype(np.float32)
            reach[:, i] = total
        reach[:, len(share) :] = total[:, None]
        self.reach[nodes] = reach
        for i in range(len(share) - 1, -1, -1):
            np.putmask(greatest, share[i] == top, i)
        share[greatest, np.arange(share.shape[1])] = 0
        self.rest[nodes] = self._sum(share)

    def on(self, node: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The node size characters on; only where some are left."""
        return self.start[self.row[node] - size] + self.word[node]

    def joined(self, other: Lattice, rooms: dict[str, np.ndarray]) -> Lattice:
        """This lattice's words and then other's, in rooms where this one's tables stand in front already."""
        both = object.__new__(Lattice)
        n, m = len(self.code), len(other.code)
        for name in ("step", "reach", "piece", "code", "left", "word", "size", "rest", "row"):
            mine, more = getattr(self, name), getattr(other, name)
            if name not in rooms or len(rooms[name]) < n + m:
                rooms[name] = np.empty((n + m + m // 2, *mine.shape[1:]), mine.dtype)
                rooms[name][:n] = mine
            rooms[name][n : n + m] = more
            setattr(both, name, rooms[name][: n + m])
        both.row[n:] += len(self.start)
        both.start = np.concatenate([self.start, other.start + n])
        both.length = np.concatenate([self.length, other.length])
        both.firsts = np.concatenate([self.firsts, other.firsts + n])
        return both


class Words:
    """Lattices of a batch's words. Those that came up again and again in the first batches are kept, which saves time and changes nothing else."""

    LEARN, MOST = 16, 20_000

    def __init__(self, pieces: Pieces) -> None:
        self.pieces, self.batches = pieces, 0
        self.counts: Counter[str] = Counter()
        self.ids: dict[str, int] = {}
        self.kept: Lattice | None = None
        self.rooms: dict[str, np.ndarray] = {}

    def lattice(self, words: list[str], counts: np.ndarray) -> tuple[Lattice, np.ndarray]:
        """The lattice of distinct words, which came up so many times, and their places in it."""
        if self.batches < self.LEARN:
            self.batches += 1
            self.counts.update(dict(zip(words, counts.tolist(), strict=True)))
        elif self.kept is None:
            often = sorted((w for w, n in self.counts.items() if n > 1 and len(w) < 64), key=self.counts.__getitem__, reverse=True)[: self.MOST]
            self.counts.clear()
            self.ids, self.kept = dict(zip(often, range(len(often)), strict=True)), Lattice(often, self.pieces)
        if self.kept is None:
            return Lattice(words, self.pieces), np.arange(len(words))
        places = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(places < 0)
        places[new] = np.arange(len(self.ids), len(self.ids) + len(new))
        return self.kept.joined(Lattice([words[i] for i in new.tolist()], self.pieces), self.rooms), places


def parts_of(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct parts of texts, the place of each part among these, and how many parts each text has. A part is a line's end, or what goes from a word mark or a
    line's start to the next one."""
    raw = pa.array([b" " + t.encode("utf-8", "surrogatepass") if t else b"" for t in texts], pa.large_binary())
    cut = pc.replace_substring(pc.replace_substring(raw, b" ", b"\xff "), b"\n", b"\xff\n\xff")  # a byte that UTF-8 doesn't have
    found = pc.split_pattern(cut, b"\xff")
    parts, sizes = found.flatten(), pc.list_value_length(found).to_numpy(zero_copy_only=False)
    full = pc.greater(pc.binary_length(parts), 0)
    text = np.repeat(np.arange(len(texts)), sizes)[full.to_numpy(zero_copy_only=False)]
    coded = parts.filter(full).dictionary_encode()
    # all as one string, line by line; the line's end itself is the empty line
    lines = pc.if_else(pc.equal(coded.dictionary, b"\n"), b"", coded.dictionary)
    joined = pc.binary_join(pa.ListArray.from_arrays([0, len(lines)], lines), pa.scalar(b"\n", lines.type))[0].as_py()
    distinct = joined.decode("utf-8", "surrogatepass").replace(MARK, LITERAL).replace(" ", MARK).split("\n") if len(lines) else []
    distinct = [w or "\n" for w in distinct]
    return distinct, coded.indices.to_numpy().astype(np.int64), np.bincount(text, minlength=len(texts))


@lru_cache(maxsize=1)
def pieces_for(model: bytes, alpha: float = ALPHA) -> Pieces:
    """A worker's own, for as long as it lives: some 15 MB."""
    return Pieces(model, alpha)


class Memory:
    """Within a task freed memory of up to 256 MB stays with the worker, because large arrays come and go with every batch, and giving them back each time costs a sixth
    of the time. At the task's end all of it goes back to the system, so that an idle worker takes none from its executor, and the usual limits hold again."""

    MMAP_THRESHOLD, TRIM_THRESHOLD, KEEP, USUAL = -3, -1, 1 << 28, 1 << 20

    def _limits(self, size: int) -> None:
        with contextlib.suppress(OSError, AttributeError):  # glibc only
            libc = ctypes.CDLL(None)
            libc.mallopt(self.MMAP_THRESHOLD, size)
            libc.mallopt(self.TRIM_THRESHOLD, size)
            if size == self.USUAL:
                libc.malloc_trim(0)

    def __enter__(self) -> None:
        self._limits(self.KEEP)

    def __exit__(self, *_) -> None:
        self._limits(self.USUAL)


def uniform(seeds: np.ndarray, text: np.ndarray | slice, path: int, place: np.ndarray, use: int) -> np.ndarray:
    """A number in (0, 1) for each place of a text; seeds are by text."""
    base = scramble(seeds + U64((path * 4 + use + 1) * int(GOLD) % 2**64))
    x = place.astype(np.uint64)
    x *= MUL
    x += base[text]
    x = scramble(x)
    x >>= U64(11)
    return (x.astype(np.float64) + 0.5) * 2.0**-53


class Path:
    """One segmentation of each text: flat arrays of steps, text by text."""

    def __init__(self, node: np.ndarray, place: np.ndarray, size: np.ndarray, chance: np.ndarray, counts: np.ndarray) -> None:
        self.node, self.place, self.size, self.chance, self.counts = node, place, size, chance, counts
        self.first = np.cumsum(counts) - counts
        self.text = np.repeat(np.arange(len(counts)), counts)
        logs = np.log(chance)
        sums = np.cumsum(logs)
        self.before = sums - logs - np.repeat(np.append(0.0, sums)[self.first], counts)  # log probability of the steps before
        self.total = np.add.reduceat(np.append(logs, 0.0), self.first) * (counts > 0)


class Search:
    #: Sets of a log mass under this get no value at first: a value is less than SPAN over the log mass, so they can't be among the best ones
    #: unless those are lower than FLOOR + SPAN; then all is done again with every set.
    FLOOR, SPAN = -80.0, 37.0

    def __init__(self, texts: list[str], keys: list[int | None], words: Words, samples: int = SAMPLES, seed: int = SEED) -> None:
        self.pieces, self.samples, self.floor = words.pieces, samples, self.FLOOR
        distinct, part, self.counts = parts_of(texts)
        self.lattice, places = words.lattice(distinct, np.bincount(part, minlength=len(distinct)))
        self.word = places[part]
        self.text = np.repeat(np.arange(len(texts)), self.counts)
        length = self.lattice.length[self.word]
        place = np.cumsum(length) - length
        first = np.cumsum(self.counts) - self.counts
        self.place = place - np.repeat(np.append(place, 0)[first], self.counts)
        self.seed = scramble(np.fromiter((xxhash.xxh3_64_intdigest(str(k).encode(), seed) for k in keys), np.uint64, len(keys)))

    def walk(self, path: int, tokens: np.ndarray, node: np.ndarray, place: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, ...]:
        """Random paths through the rest of each token's word, from node: token, number of the step from here, node, place, size, chance."""
        out, number = [], 0
        while len(tokens):
            u = uniform(self.seed, text, path, place, 0).astype(np.float32)
            size = (self.lattice.reach.take(node, axis=0) > u[:, None]).argmax(axis=1) + 1
            left = self.lattice.left[node]
            np.minimum(size, left, out=size)
            chance = self.lattice.step.reshape(-1).take(node * self.lattice.step.shape[1] + size - 1)
            odd = np.flatnonzero(chance <= 0)  # rounding at a row's end
            if len(odd):
                size[odd] = self.lattice.step[node[odd]].argmax(axis=1) + 1
                chance[odd] = self.lattice.step[node[odd], size[odd] - 1]
            out.append((tokens, np.full(len(tokens), number), node, place, size, chance))
            live = np.flatnonzero(size < left)
            size = size[live]
            tokens, node, place, text, number = tokens[live], self.lattice.on(node[live], size), place[live] + size, text[live], number + 1
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.empty(0, np.int64) for _ in range(6))

    def assemble(self, steps: tuple[np.ndarray, ...], heads: list[tuple[Path, np.ndarray]] = (), upto: np.ndarray | int = 0) -> Path:
        """A path of the steps, after the upto steps of each text that heads (paths and places in them) give. Each goes to its place without sorting."""
        token, number = steps[:2]
        in_token = np.bincount(token, minlength=len(self.word))
        tail = np.bincount(self.text, weights=in_token, minlength=len(self.counts)).astype(np.int64)
        counts = tail + upto
        first = np.cumsum(counts) - counts
        before = np.cumsum(in_token) - in_token + np.repeat((first + upto) - (np.cumsum(tail) - tail), self.counts)
        spots = [before[token] + number, *(first[p.text[h]] + h - p.first[p.text[h]] for p, h in heads)]
        parts = []
        for i, name in enumerate(("node", "place", "size", "chance")):
            out = np.empty(int(counts.sum()), np.float64 if name == "chance" else np.int32)
            for spot, values in zip(spots, (steps[i + 2], *(getattr(p, name)[h] for p, h in heads)), strict=True):
                out[spot] = values
            parts.append(out)
        return Path(*parts, counts)

    def gumbel_under(self, log_mass: np.ndarray, top: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Gumbel variables at log_mass, given that they are under top."""
        with np.errstate(divide="ignore"):
            return -np.logaddexp(-top, np.log(-np.log(u)) - log_mass)

    def leave(self, path: int, p: Path, top: np.ndarray, since: np.ndarray) -> np.ndarray:
        """Values of the sets of paths that leave p at each step, from step number `since` of each text on."""
        value = np.full(len(p.node), -np.inf)
        m = np.flatnonzero(p.before >= self.floor)
        m = m[m - p.first[p.text[m]] >= since[p.text[m]]]
        m = m[self.lattice.rest[p.node[m]] > 0]
        chance, others = p.chance[m], self.lattice.rest[p.node[m]].astype(np.float64)
        mass = p.before[m] + np.log(np.where(chance > 0.5, others, 1 - chance))
        value[m] = self.gumbel_under(mass, top[p.text[m]], uniform(self.seed, p.text[m], path, p.place[m], 1))
        return value

    def run(self) -> tuple[list[Path], np.ndarray, np.ndarray]:
        """Paths, their perturbed values (samples, texts; -inf: there is none) and the value after the last."""
        n = len(self.counts)
        nothing = np.zeros(n, np.int64)
        every = np.arange(len(self.word))
        first = self.assemble(self.walk(0, every, self.lattice.firsts[self.word], self.place, self.text))
        value = -np.log(-np.log(uniform(self.seed, slice(None), 0, np.full(n, 2**40), 2)))
        paths, values = [first], [value]
        left = [self.leave(0, first, value, nothing)]
        excluded: list[dict[int, int]] = [{}]  # per path: steps at which more than the path's own edge is taken, as bits of lengths
        rest: list[list[tuple[float, int, int, int]]] = [[] for _ in range(n)]  # value, path, step, bits: what is left at a node that was split
        for k in range(1, self.samples + 1):
            best, where, source = np.full(n, -np.inf), np.zeros(n, np.int64), np.full(n, -1)
            for j, (p, v) in enumerate(zip(paths, left, strict=True)):
                some = p.counts > 0
                top = np.full(n, -np.inf)
                if some.any():
                    top[some] = np.maximum.reduceat(v, p.first[some])
                at_top = np.flatnonzero(np.isfinite(v))
                at_top = at_top[v[at_top] == top[p.text[at_top]]]
                spot = np.zeros(n, np.int64)
                spot[p.text[at_top[::-1]]] = at_top[::-1]
                better = top > best
                best[better], where[better], source[better] = top[better], spot[better], j
            bits = {}
            for t in range(n):
                if rest[t] and (r := max(rest[t]))[0] > best[t]:
                    best[t], source[t], where[t] = r[0], r[1], r[2]
                    bits[t] = r[3]
                    rest[t].remove(r)
            if k == self.samples:
                unsure = (best < self.floor + self.SPAN) & (np.min([p.total for p in paths], axis=0) < self.floor)
                if unsure.any():
                    self.floor = -np.inf
                    return self.run()
                return paths, np.stack(values), best
            todo = np.flatnonzero(np.isfinite(best))
            node, place, taken = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            before, upto = np.zeros(n), np.zeros(n, np.int64)
            for j, p in enumerate(paths):
                mine = todo[source[todo] == j]
                w = where[mine]
                node[mine], place[mine], taken[mine], before[mine], upto[mine] = p.node[w], p.place[w], 1 << (p.size[w] - 1), p.before[w], w - p.first[mine]
                plain = np.array([t not in bits for t in mine.tolist()], bool)
                left[j][w[plain]] = -np.inf
            for t, b in bits.items():
                taken[t] = b
            # the edge by which the set is entered: any but those taken
            chances = self.lattice.step[node[todo]].astype(np.float64)
            chances[(taken[todo][:, None] >> np.arange(chances.shape[1])) & 1 == 1] = 0
            mass = chances.sum(axis=1)
            u = uniform(self.seed, todo, k, place[todo], 3) * mass
            size = np.minimum((np.cumsum(chances, axis=1) <= u[:, None]).sum(axis=1), chances.shape[1] - 1)
            odd = chances[np.arange(len(todo)), size] <= 0
            size[odd] = chances[odd].argmax(axis=1)
            chance = chances[np.arange(len(todo)), size]
            chances[np.arange(len(todo)), size] = 0
            size = size + 1
            left_mass = chances.sum(axis=1)
            for t, m, s in zip(todo.tolist(), left_mass.tolist(), size.tolist(), strict=True):
                if m > 0:
                    v = self.gumbel_under(np.array([before[t] + np.log(m)]), best[t : t + 1], uniform(self.seed[t : t + 1], slice(None), k, place[t : t + 1], 2))[0]
                    rest[t].append((float(v), int(source[t]), int(where[t]), int(taken[t]) | 1 << (s - 1)))
            paths.append(self.follow(k, paths, source, upto, todo, node, place, size, chance))
            values.append(best)
            since = upto + 1
            since[~np.isfinite(best)] = 2**60
            left.append(self.leave(k, paths[-1], best, since))
        raise AssertionError

    def follow(self, k: int, paths: list[Path], source: np.ndarray, upto: np.ndarray, todo: np.ndarray, node: np.ndarray, place: np.ndarray, size: np.ndarray, chance: np.ndarray) -> Path:
        """The path that shares its first upto steps with paths[source], takes the edge of the given size from node, and goes on at random."""
        n = len(self.counts)
        start = np.full(n, 2**60)
        start[todo] = place[todo]
        ends_at = self.place + self.lattice.length[self.word]
        inside = np.flatnonzero((self.place <= start[self.text]) & (ends_at > start[self.text]))  # the word of the edge, one for each text of todo
        after = np.flatnonzero(self.place > start[self.text])
        edge_end = np.zeros(n, np.int64)
        edge_end[todo] = size
        go = inside[start[self.text[inside]] + edge_end[self.text[inside]] < ends_at[inside]]
        t = self.text[go]
        tokens = np.concatenate([go, after])
        nodes = np.concatenate([self.lattice.on(node[t], edge_end[t]), self.lattice.firsts[self.word[after]]])
        places = np.concatenate([start[t] + edge_end[t], self.place[after]])
        token, number, *rest = self.walk(k, tokens, nodes, places, self.text[tokens])
        split = np.zeros(len(self.word), np.int64)
        split[inside] = 1  # the edge's own step comes first in its word
        chances = np.zeros(n)
        chances[todo] = chance
        t = self.text[inside]
        own = (inside, np.zeros(len(inside), np.int64), node[t], start[t], edge_end[t], chances[t])
        steps = tuple(np.concatenate([a, b]) for a, b in zip(own, (token, number + split[token], *rest), strict=True))
        heads = []
        for j, p in enumerate(paths):
            many = np.where(source == j, upto, 0)
            heads.append((p, np.arange(many.sum()) + np.repeat(p.first - (np.cumsum(many) - many), many)))
        return self.assemble(steps, heads, upto)

    def ids(self, p: Path) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts, and how many each has."""
        out = self.lattice.piece.reshape(-1).take(p.node.astype(np.int64) * self.lattice.piece.shape[1] + p.size - 1).astype(np.int32)
        spelled = np.flatnonzero(out < 0)
        if not len(spelled):
            return out, p.counts
        many = np.ones(len(out), np.int64)
        many[spelled] = self.lattice.size[p.node[spelled]]
        spots = np.cumsum(many) - many
        out = np.repeat(out, many)
        code = self.lattice.code[p.node[spelled]].astype(np.int64)
        code[code == ord(LITERAL)] = ord(MARK)
        spots, many_ = spots[spelled], many[spelled]
        for size, lead in ((1, 0), (2, 0xC0), (3, 0xE0), (4, 0xF0)):  # UTF-8
            m = many_ == size
            for k in range(size):
                part = code[m] >> (6 * (size - 1 - k))
                out[spots[m] + k] = self.pieces.byte[lead | part if k == 0 else 0x80 | (part & 0x3F)]
        return out, p.counts + np.bincount(p.text[spelled], weights=many_ - 1, minlength=len(self.counts)).astype(np.int64)


def sample(texts: list[str], keys: list[int | None], words: Words, samples: int = SAMPLES, seed: int = SEED) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text its samples, the best first: ids, log probability, perturbed value, inclusion score."""
    search = Search(texts, keys, words, samples, seed)
    paths, values, kappa = search.run()
    out: list[list[tuple]] = [[] for _ in texts]
    for p, value in zip(paths, values, strict=True):
        ids, counts = search.ids(p)
        parts = np.split(ids, np.cumsum(counts)[:-1])
        with np.errstate(over="ignore"):
            inclusion = -np.expm1(-np.exp(p.total - kappa))
        for t in np.flatnonzero(np.isfinite(value)).tolist():
            out[t].append((parts[t], float(p.total[t]), float(value[t]), float(inclusion[t])))
    return out


def in_batches(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[list[tuple]]:
    """Rows whose second column is a text, BATCH_CHARS characters or so at once."""
    rows, size = [], 0
    for row in rows_of(batches, *columns):
        rows.append(row)
        size += len(row[1] or "") + 50
        if size >= BATCH_CHARS:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def sampler(model: bytes, samples: int, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kinds = [("n_tokens", pa.int64()), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("inclusion", pa.float64()), ("ids_sha256", pa.string()), ("round_trip", pa.bool_())]
    kind = pa.list_(pa.struct([*kinds, *([("ids", pa.list_(pa.int32()))] if with_ids else [])]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Memory():
            yield from sampled(batches)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(pieces_for(model))  # lattices of this task, freed with it
        pieces = words.pieces
        for rows in in_batches(batches, "doc_id", "text"):
            given = [i for i, (_, text) in enumerate(rows) if text is not None]
            found = sample([rows[i][1] for i in given], [rows[i][0] for i in given], words, samples)
            out: list[list[dict] | None] = [None] * len(rows)
            for i, some in zip(given, found, strict=True):
                raw = rows[i][1].encode("utf-8", "surrogatepass")
                out[i] = [
                    {"n_tokens": len(ids), "log_prob": lp, "perturbed": g, "inclusion": q, "ids_sha256": hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest(), "round_trip": pieces.decode(ids) == raw}
                    | ({"ids": ids} if with_ids else {})
                    for ids, lp, g, q in some
                ]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(out, kind)], names=["doc_id", "samples"])

    return each


_SAMPLE = "n_tokens: long, log_prob: double, perturbed: double, inclusion: double, ids_sha256: string, round_trip: boolean"


def sample_documents(docs: DataFrame, samples: int = SAMPLES, with_ids: bool = True, path: str = MODEL) -> DataFrame:
    """(doc_id, samples): one row per row of docs; decoding is proved for each sample."""
    schema = f"doc_id long, samples array<struct<{_SAMPLE}{', ids: array<int>' if with_ids else ''}>>"
    with open(path, "rb") as file:  # read here, and sent along with the tasks, so that executors need no such file
        model = file.read()
    return docs.select("doc_id", "text").mapInArrow(sampler(model, samples, with_ids), schema)


def op9_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_documents(read(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' sampled segmentations with their piece ids."""
    return sample_documents(docs)
