"""Documents with every awkward row, and brute-force versions."""

import re
import zlib
from collections import Counter, defaultdict

BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


def awkward(spark):
    """Nulls in every column, empty and blank texts, repeated rows, repeated ids, a long text, ties, and columns with the names of working ones."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    rows = [
        (1, BASE, "en", "a"), (1, BASE, "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, " \n\t ", "en", None), (None, BASE, "en", "a"), (5, BASE + " more", None, "b"), (6, long, "de", "b"),
        (7, "one", "en", "a"), (7, "two words", "en", "a"), (8, BASE.upper(), "en", "a"), (9, "MIT license, GNU General Public License\n\ncc-by", "en", "a"), (10, "Ünï ΑΣ ▁x \U0001f600 \x00\x01", "xx", "c"),
    ]
    clash = ["_id", "_t", "c0", "keys", "n_words", "kept", "_gone", "node", "spans"]
    return spark.createDataFrame([(*r, *[f"v{i}"] * len(clash)) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in clash))


def empty(spark):
    return awkward(spark).limit(0)


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 10 == 0


def groups(rows, k, percent):
    """component of each (id, text), by all pairs that share a shingle."""
    sets = []
    for _, t in rows:
        w = space_words(low(t))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            where[g].append(i)
    for i, s in enumerate(sets):
        for j, both in Counter(j for g in s for j in where[g] if j < i).items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[root(i)].append(d)
    return [(len(s), min((d for d in least[root(i)] if d is not None), default=None)) for i, s in enumerate(sets)]


def repeated_bytes(rows, length):
    """{(id, text): (kept bytes, removed, spans)}, documents with one id not being earlier than each other."""
    first, out = {}, {}
    data = {(d, t): (t or "").encode() for d, t in rows}
    order = sorted(data, key=lambda x: 2**63 if x[0] is None else x[0])
    for key in order:
        for p in range(len(data[key]) - length + 1):
            w = data[key][p : p + length]
            d = 2**63 if key[0] is None else key[0]
            first.setdefault(w, (d, key, p))
    for key in order:
        b, d = data[key], 2**63 if key[0] is None else key[0]
        gone, seen = bytearray(len(b)), set()
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if first[w][0] < d or w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        out[key] = bytes(x for x, g in zip(b, gone, strict=True) if not g), sum(gone), len(re.findall(rb"\x01+", bytes(gone)))
    return out
