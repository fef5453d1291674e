"""Passages that repeat, also with small changes, across documents, by collinear chaining.

1. Seeds: the k-word windows whose hash is the least of ``spread`` neighbours, so texts that share k + spread - 1 words in a row
   share a seed, and texts that share fewer often do.
2. Matches: the head of a seed is the smallest document of the table that holds it, and a match joins each other occurrence
   with the head's. To find the head a batch of rows sends one document for each of its seeds; where several of its documents
   hold a seed, the head is sent back to the batch. So a seed of any number of documents makes as many matches as it has
   occurrences, no task holds more of it than one document for each batch, and how rows are dealt does not matter.
3. Windows: heads of neighbouring seeds can differ, and each may hold only a part of a passage. So the windows of min_words
   words whose seeds are all shared, as those of a verbatim passage are, are matched as well, in the same way: each such match
   is a passage by itself, whatever fragments stand in other documents.
4. Chains: the matches of two documents are merged along diagonals and chained in order by a Fenwick tree of prefix maxima, a
   gap costing GAP_COST a word; chains are cut at gaps of more than MAX_GAP words.
5. Alignment: only the words in the gaps and near both ends are fetched, answered by one reading of each text concerned. Gaps
   are aligned by edit distance, ends are followed along the diagonal across differences, and the best parts whose errors are
   at most 1 - identity of their words, and which are long enough, come out.
6. What is left: shared seeds that no passage of their document covers may have met a head that holds a fragment only. They are
   met again, each with all other documents that are left with the seed, or with the first FEW where more than ALL hold it.
   Pairs of documents that have only matches of step 2 are not aligned again.
7. The rest of the pairs of such frequent seeds: a chain of EVIDENCE words has two seeds that do not overlap, so documents that
   share two such seeds, one of them frequent, meet: all pairs of up to ALL documents. Of more, those pairs meet whose words
   around the two seeds can hold a passage: alike enough texts of min_words words have a least number of short runs of words in
   common, so of two texts each without its most frequent runs, one less than that number, some run is common to both.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import buckets as parts_of
from ._store import cut, drop, map_arrow
from ._text import mix, portions, powers, shingles, words

K, SPREAD = 5, 8
MIN_WORDS, IDENTITY = 50, 0.8
#: Documents that are left with a seed up to which all pairs are aligned; of more, how many are aligned with all others before
#: joint() looks for the rest.
ALL, FEW = 32, 8
#: Documents of two joint seeds that a task compares with each other; more are compared tile by tile.
TILE = 5000
#: Places of the table that tells which words stand around a row; words that share one count as equal there.
SLOTS = 4096
#: Words of a gap in a chain at most; what each costs; equal words that a chain needs to be aligned; words fetched at its ends.
MAX_GAP, GAP_COST, EVIDENCE, MARGIN = 40, 0.2, 10, 48
GIVE_UP, BROADCAST_ROWS = 8, 500_000
#: Requests for one text that a task answers; a text with more goes to several.
REQUESTS = 5000
SEED = np.dtype([("key", "<u8"), ("doc", "<i8"), ("pos", "<u4")])
SPAN = np.dtype([("doc", "<i8"), ("pos", "<u4"), ("n", "<u4")])
#: Seeds after which what was found is packed.
PACKED = 1 << 20
#: Bits of a document's id that deal its places to buckets.
LOW_BITS = (1 << 62) - 1
#: Keys are kept to so many bytes when they travel; with their bucket they still tell billions of seeds apart.
KEY_BYTES = 6
MATCH = np.dtype([("doc", "<i8"), ("head", "<i8"), ("pos", "<i4"), ("at", "<i4"), ("n", "<i4")])
#: Two seeds of a document: their places, whether passages cover both, the tile of the document and how many there are.
JOINT = np.dtype([("key", "<u8"), ("doc", "<i8"), ("pos", "<u4"), ("next", "<u4"), ("done", "?"), ("tile", "<u2"), ("tiles", "<u2")])
#: The same with the two tiles to compare, the number of words around them that follow, and how many times they stand there, each
#: some words after the one before.
NEAR = np.dtype([*JOINT.descr[:-1], ("a", "<u2"), ("b", "<u2"), ("n", "<u4"), ("times", "<u2"), ("step", "<u2")])
#: What packed rows hold: first documents of seeds, matches, places of shared seeds, other documents of seeds that several
#: documents of a batch hold, the heads sent back to these, the words of documents that passages cover, joint seeds, and
#: documents as 16-bit hashes of their words.
FIRSTS, MATCHES, PLACES, OTHERS, HEADS, SPANS, JOINTS, HASHES = range(8)
PACKED_SCHEMA = "kind int, bucket int, mark long, rows binary"


def _slide(x: np.ndarray, n: int, pick) -> np.ndarray:
    """pick over x[i : i + n] for each i (the last windows are short)."""
    done = 1
    while done < n:
        by = min(done, n - done)
        x = np.concatenate([pick(x[:-by], x[by:]), x[len(x) - by :]]) if len(x) > by else x
        done += by
    return x


def seeds(texts: pa.Array, ids: np.ndarray, k: int = K, spread: int = SPREAD) -> np.ndarray:
    """The seeds of texts, as SEED rows in order of text and place. ids: one integer for each text."""
    h, first = words(texts)
    if len(h) < k:
        return np.zeros(0, SEED)
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    key = np.full(len(h), none)
    key[: len(h) - k + 1] = shingles(h, k)
    for j in range(1, k):  # windows that reach into the next text
        last = first[1:] - j
        key[last[last >= first[:-1]]] = none
    low = _slide(key, spread, np.minimum)
    # the least of some window: it is the greatest of the least values of the windows around it
    back = _slide(low[::-1], spread, np.maximum)[::-1]
    at = np.flatnonzero((key == back) & (key != none))
    text = np.searchsorted(first, at, "right") - 1
    out = np.zeros(len(at), SEED)
    out["key"], out["doc"], out["pos"] = key[at], ids[text], at - first[text]
    return out


def windows(texts: pa.Array, ids: np.ndarray, flags: np.ndarray, n: int, k: int, spread: int) -> np.ndarray:
    """The n-word windows of texts that can stand in two documents, as SEED rows. flags: shared seeds, SEED rows in order of doc.

    Of the seeds of such a window those that its own words decide are shared, at least one in ``spread`` places.
    """
    h, first = words(texts)
    if len(h) < n:
        return np.zeros(0, SEED)
    may = np.ones(len(h), bool)
    places = n - k - spread + 2
    if places > 0:
        may[:] = False
        begin, end = np.searchsorted(flags["doc"], ids), np.searchsorted(flags["doc"], ids, "right")
        for a, b, s, e in zip(first[:-1].tolist(), first[1:].tolist(), begin.tolist(), end.tolist(), strict=True):
            at = flags["pos"][s:e].astype(np.int64)
            may[a + at[at < b - a]] = True
        may = _slide(_slide(may, spread, np.logical_or), places, np.logical_and)
    may[len(h) - n + 1 :] = False
    for j in range(1, n):  # windows that reach into the next text
        last = first[1:] - j
        may[last[last >= first[:-1]]] = False
    at = np.flatnonzero(may)
    text = np.searchsorted(first, at, "right") - 1
    power, inverse = powers(len(h))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[: len(h)])])
    out = np.zeros(len(at), SEED)
    out["key"], out["doc"], out["pos"] = mix((sums[at + n] - sums[at]) * inverse[at]), ids[text], at - first[text]
    return out


def _sorted(s: np.ndarray) -> np.ndarray:
    """Distinct SEED rows by key, document and place."""
    s = s[np.lexsort((s["pos"], s["doc"], s["key"]))]
    again = np.zeros(len(s), bool)
    again[1:] = s[1:] == s[:-1]
    return s[~again]


def _groups(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted SEED rows: where keys begin, each row's key by number, and whether it is of the key's first document."""
    new = np.ones(len(s), bool)
    new[1:] = s["key"][1:] != s["key"][:-1]
    start, group = np.flatnonzero(new), np.cumsum(new) - 1
    return start, group, s["doc"] == s["doc"][start][group]


def matched(s: np.ndarray, n: int = K) -> np.ndarray:
    """The matches, of n words each, of the seeds of other documents with those of the first, of sorted SEED rows.

    Where a document holds a seed several times the n-th place goes with the n-th of the head, so that runs of one repeated line
    or word match along one diagonal. If the head has fewer, its places are gone through again, so that a run longer than the
    head's is laid out with several of these.
    """
    if not len(s):
        return np.zeros(0, MATCH)
    start, group, mine = _groups(s)
    turn = np.ones(len(s), bool)
    turn[1:] = (s["key"][1:] != s["key"][:-1]) | (s["doc"][1:] != s["doc"][:-1])
    nth = np.arange(len(s)) - np.flatnonzero(turn)[np.cumsum(turn) - 1]
    held = np.add.reduceat(mine.astype(np.int64), start)[group]
    other = np.flatnonzero(~mine)
    a, b = s[other], s[start[group[other]] + nth[other] % held[other]]
    out = np.zeros(len(other), MATCH)
    out["doc"], out["head"], out["pos"], out["at"], out["n"] = a["doc"], b["doc"], a["pos"], b["pos"], n
    return out


def left(s: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """The seeds of k words, SEED rows, that no SPAN row of their document covers."""
    return s[~covered(s, spans)]


def covered(s: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Whether a SPAN row of their document covers the first word of seeds, SEED rows."""
    if not len(s) or not len(spans):
        return np.zeros(len(s), bool)
    docs = np.unique(spans["doc"])
    spans = spans[np.lexsort((spans["pos"], spans["doc"]))]
    # a line of all documents that have spans: where each span begins, and the furthest reach of those up to it
    begin = (np.searchsorted(docs, spans["doc"]).astype(np.int64) << 33) + spans["pos"]
    reach = np.maximum.accumulate(begin + spans["n"])
    number = np.minimum(np.searchsorted(docs, s["doc"]), len(docs) - 1)
    at = (number.astype(np.int64) << 33) + s["pos"]
    i = np.searchsorted(begin, at, "right") - 1
    return (docs[number] == s["doc"]) & (i >= 0) & (reach[i] > at)


def met_again(s: np.ndarray, heads: np.ndarray, n: int = K) -> Iterator[np.ndarray]:
    """The matches of sorted SEED rows of several documents, by turns with the first, second, ... document of each seed as head.

    Those with one of heads, SEED rows that were heads before, have -n words.
    """
    if not len(s):
        return
    start, group, _ = _groups(s)
    turn = np.ones(len(s), bool)
    turn[1:] = (s["key"][1:] != s["key"][:-1]) | (s["doc"][1:] != s["doc"][:-1])
    number = np.cumsum(turn)
    rank, count = number - number[start][group], np.add.reduceat(turn.astype(np.int64), start)[group]
    known = np.zeros(len(start), bool)
    if len(heads):
        heads = heads[np.argsort(heads["key"], kind="stable")]
        at = np.minimum(np.searchsorted(heads["key"], s["key"][start]), len(heads) - 1)
        known = (heads["key"][at] == s["key"][start]) & (heads["doc"][at] == s["doc"][start])
    known = known[group]
    for i in range(ALL - 1):
        now = (rank >= i) & (count > i + 1) & ((count <= ALL) | (i < FEW))
        if not now.any():
            return
        if not i:
            yield matched(s[now & known], -n)
            now &= ~known
        yield matched(s[now], n)


def joint(s: np.ndarray, often: np.ndarray, done: np.ndarray, k: int = K) -> np.ndarray:
    """Two seeds of a document that do not overlap and that a chain can join, one of them frequent, as JOINT rows.

    s: SEED rows of k words, by document and place. Of several second seeds of one key the next counts.
    """
    found = [np.zeros(0, JOINT)]
    for j in range(1, len(s)):
        far = s["pos"][j:].astype(np.int64) - s["pos"][:-j]
        near = (s["doc"][j:] == s["doc"][:-j]) & (far < MAX_GAP + 2 * k)
        if not near.any():
            break
        i = np.flatnonzero(near & (far >= k) & (often[j:] | often[:-j]))
        x = np.zeros(len(i), JOINT)
        x["key"] = mix(mix(s["key"][i]) + s["key"][i + j])
        x["doc"], x["pos"], x["next"], x["done"] = s["doc"][i], s["pos"][i], s["pos"][i + j], done[i] & done[i + j]
        found.append(x)
    out = np.concatenate(found)
    out = out[np.lexsort((out["next"], out["pos"], out["doc"], out["key"]))]
    first = np.ones(len(out), bool)
    first[1:] = out[["key", "doc", "pos"]][1:] != out[["key", "doc", "pos"]][:-1]
    return out[first]


def joint_met(x: np.ndarray, k: int = K) -> tuple[list[np.ndarray], np.ndarray]:
    """Of JOINT rows the matches of all pairs of up to ALL documents, and the rows that more documents share, with tiles."""
    x = x[np.lexsort((x["next"], x["pos"], x["doc"], x["key"]))]
    if not len(x):
        return [], x
    s = np.zeros(len(x), SEED)
    s["key"], s["doc"], s["pos"] = x["key"], x["doc"], np.arange(len(x))
    start, group, _ = _groups(s)
    turn = np.ones(len(s), bool)
    turn[1:] = (s["key"][1:] != s["key"][:-1]) | (s["doc"][1:] != s["doc"][:-1])
    count = np.add.reduceat(turn.astype(np.int64), start)
    count[np.logical_and.reduceat(x["done"], start)] = 0
    found, count = [], count[group]
    for m in met_again(s[(count > 1) & (count <= ALL)], s[:0], k):
        m = m[~(x["done"][m["pos"]] & x["done"][m["at"]])]
        a, b = x[m["pos"]], x[m["at"]]
        found += _both(a, b, k)
    many = count > ALL
    size = np.bincount(group)[group]
    x["tile"], x["tiles"] = (np.arange(len(x)) - start[group]) // TILE, -(-size // TILE)
    return found, x[many]


def _both(a: np.ndarray, b: np.ndarray, k: int) -> list[np.ndarray]:
    """The matches of both seeds of JOINT rows, side by side; the smaller document is the head."""
    swap = a["doc"] < b["doc"]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    out = []
    for place in ("pos", "next"):
        m = np.zeros(len(a), MATCH)
        m["doc"], m["head"], m["pos"], m["at"], m["n"] = a["doc"], b["doc"], a[place], b[place], k
        out.append(m)
    return out


def repeated(x: list[tuple], k: int, most: int) -> list[list]:
    """JOINT rows of one document, each key's by place, with (times, step): those that come again after k words or less as one.

    These are the rows of a run of one word or short line, over ``most`` words at most.
    """
    out, last = [], {}
    for key, doc, pos, after, done, tile, tiles in x:
        row = last.get((key, done, tile))
        if row:
            times, step = row[-2:]
            by = pos - row[2] - (times - 1) * step
            if 0 < by <= k and after - row[3] == pos - row[2] <= most and (times == 1 or by == step):
                row[-2:] = times + 1, by
                continue
        last[key, done, tile] = row = [key, doc, pos, after, done, tile, tiles, 1, 0]
        out.append(row)
    return out


def laid(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """The matches of both seeds of NEAR rows, side by side, of each of their places with each; the smaller document is the head.

    Those that follow on one diagonal are one match.
    """
    swap = a["doc"] < b["doc"]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    n, m = a["times"].astype(np.int64), b["times"].astype(np.int64)
    count = np.where(a["step"] == b["step"], n + m - 1, n * m)
    i = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    a, b, n, m = (np.repeat(x, count) for x in (a, b, n, m))
    even = a["step"] == b["step"]
    x, y = np.where(even, np.maximum(i - m + 1, 0), i // m), np.where(even, np.maximum(m - 1 - i, 0), i % m)
    out = np.zeros((2, len(i)), MATCH)
    out["doc"], out["head"] = a["doc"], b["doc"]
    out["n"] = k + np.where(even, (np.minimum(n - x, m - y) - 1) * a["step"], 0)
    for j, place in enumerate(("pos", "next")):
        out[j]["pos"], out[j]["at"] = a[place] + x * a["step"], b[place] + y * b["step"]
    return out.ravel()


def least_common(min_words: int, identity: float) -> tuple[int, int]:
    """(q, t): every passage has t runs of q words in common at least.

    A passage of n words with e errors has n - e equal words in e + 1 runs at most, so n - e - (q - 1)(e + 1) runs of q words.
    """
    errors = int((1 - identity) * min_words + 1e-9)
    for q in (3, 2):
        if identity >= q * (1 - identity) and (t := min_words - (q - 1) - q * errors) > 0:
            return q, t
    return 1, max(1, min_words - errors)


def stretches(w: np.ndarray, held: np.ndarray, a: np.ndarray, b: np.ndarray, min_words: int, identity: float) -> np.ndarray:
    """Whether rows a have min_words words or more in a row of which at least identity stand in rows b, in any order."""
    total = np.zeros((len(a), w.shape[1] + 1), np.float32)
    np.cumsum(held[b[:, None], w[a]] - np.float32(identity), axis=1, out=total[:, 1:])
    if total.shape[1] <= min_words:
        return np.zeros(len(a), bool)
    least = np.minimum.accumulate(total[:, :-min_words], axis=1)
    return (total[:, min_words:] - least).max(axis=1) > -0.01


def alike(rows: np.ndarray, near: np.ndarray, min_words: int, identity: float) -> np.ndarray:
    """The pairs (row, row) of NEAR rows of one key and two tiles between whose words around a passage can stand.

    near: the words around the rows, one after another. A passage has ``least`` runs of q words in common and is a stretch of
    each text whose words, but for 1 - identity, stand in the other. Each row's most frequent runs, less than ``least``, are put
    aside: of pairs with so many in common the rarest is not among them, as the others come after it.
    """
    q, least = least_common(min_words, identity)
    none = np.zeros((0, 2), np.int64)
    row = np.repeat(np.arange(len(rows)), rows["n"])
    runs = shingles(near.astype(np.uint64), q)
    inside = row[: len(runs)] == row[q - 1 :] if len(runs) else np.zeros(0, bool)
    if not inside.any():
        return none
    row = row[: len(runs)][inside]
    _, run = np.unique(runs[inside], return_inverse=True)
    kinds = int(run.max()) + 1
    each, times = np.unique(row * kinds + run, return_counts=True)
    order = np.argsort(-np.bincount(each % kinds, minlength=kinds), kind="stable")
    rank = np.empty(kinds, np.int64)
    rank[order] = np.arange(kinds)
    each = each // kinds * kinds + rank[each % kinds]
    by = np.argsort(each)
    each, times = each[by], times[by]
    row, run = each // kinds, each % kinds
    begin = np.searchsorted(row, np.arange(len(rows) + 1))
    total = np.concatenate([[0], np.cumsum(times)])
    kept = np.flatnonzero(total[1:] - total[begin[row]] >= least)
    kept = kept[np.argsort(run[kept], kind="stable")]
    first = np.searchsorted(run[kept], run[kept])
    before = np.arange(len(kept)) - first  # rows before it with the run
    mine = row[kept].astype(np.int32)
    by = np.flatnonzero(before)
    by = by[np.argsort(mine[by], kind="stable")]
    sums = np.cumsum(before[by])
    n = rows["n"].astype(np.int64)
    w = np.full((len(rows), int(n.max())), SLOTS, "<u2")
    of = np.repeat(np.arange(len(rows)), n)
    w[of, np.arange(len(near)) - np.repeat(np.cumsum(n) - n, n)] = near % SLOTS
    held = np.zeros((len(rows), SLOTS + 1), bool)
    held[of, near % SLOTS] = True
    out, size, at = [none], np.diff(begin), 0
    while at < len(by):  # all entries of some rows
        stop = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + PACKED // 4, "right")))
        stop = int(np.searchsorted(mine[by], mine[by[stop - 1]], "right"))
        i, at = by[at:stop], stop
        n = before[i]
        b = mine[np.repeat(first[i] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        pairs = np.unique(np.repeat(mine[i].astype(np.int64) * len(rows), n) + b)
        a, b = pairs // len(rows), pairs % len(rows)
        fit = (rows["doc"][a] != rows["doc"][b]) & ~(rows["done"][a] & rows["done"][b])
        if rows["a"][0] != rows["b"][0]:
            fit &= rows["tile"][a] != rows["tile"][b]
        a, b = a[fit], b[fit]
        for j in range(0, len(a), 2048):
            c, d = a[j : j + 2048], b[j : j + 2048]
            for _ in range(2):
                fit = stretches(w, held, c, d, min_words, identity)
                c, d = d[fit], c[fit]
            some = np.stack([c, d], axis=1)
            flat = some.ravel()
            n = size[flat]
            place = np.repeat(begin[flat] - np.cumsum(n) + n, n) + np.arange(n.sum())
            key = np.repeat(np.arange(len(flat)) // 2, n) * kinds + run[place]
            order = np.argsort(key, kind="stable")
            key, often = key[order], times[place][order]
            same = np.flatnonzero(key[1:] == key[:-1])
            common = np.bincount(key[same] // kinds, np.minimum(often[same], often[same + 1]), len(some))
            out.append(some[common >= least])
    return np.concatenate(out)


def unmet(m: np.ndarray) -> np.ndarray:
    """The MATCH rows of those pairs of documents that have one that was not met before, all with their words counted."""
    m = m[np.lexsort((m["head"], m["doc"]))]
    if not len(m):
        return m
    pair = np.ones(len(m), bool)
    pair[1:] = (m["doc"][1:] != m["doc"][:-1]) | (m["head"][1:] != m["head"][:-1])
    m = m[np.logical_or.reduceat(m["n"] > 0, np.flatnonzero(pair))[np.cumsum(pair) - 1]]
    m["n"] = np.abs(m["n"])
    return m


def merged(m: np.ndarray) -> np.ndarray:
    """Matches of windows, those that follow word by word on one diagonal as one."""
    if not len(m):
        return m
    m = m[np.lexsort((m["pos"], m["pos"] - m["at"], m["head"], m["doc"]))]
    new = np.ones(len(m), bool)
    new[1:] = (m["doc"][1:] != m["doc"][:-1]) | (m["head"][1:] != m["head"][:-1]) | (m["pos"][1:] != m["pos"][:-1] + 1) | (m["at"][1:] != m["at"][:-1] + 1)
    start = np.flatnonzero(new)
    out = m[start]
    out["n"] += m["pos"][np.append(start[1:], len(m)) - 1] - out["pos"]
    return out


def seeds_bytes(s: np.ndarray) -> bytes:
    """SEED rows as bytes, column by column: keys cut to KEY_BYTES, documents as distances from the least where these are small."""
    low = int(s["doc"].min()) if len(s) else 0
    wide = bool(len(s)) and int(s["doc"].max()) - low >= 1 << 32
    docs = (s["doc"].astype(np.uint64) - np.uint64(low & 0xFFFFFFFFFFFFFFFF)).astype("<u8" if wide else "<u4")
    keys = np.ascontiguousarray(s["key"]).view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
    return np.array([len(s), low, wide], "<i8").tobytes() + keys.tobytes() + docs.tobytes() + s["pos"].tobytes()


def seeds_of(data: bytes) -> np.ndarray:
    n, low, wide = np.frombuffer(data, "<i8", 3).tolist()
    out, at = np.zeros(n, SEED), 24
    keys = np.zeros((n, 8), np.uint8)
    keys[:, :KEY_BYTES] = np.frombuffer(data, np.uint8, n * KEY_BYTES, at).reshape(n, KEY_BYTES)
    at += n * KEY_BYTES
    docs = np.frombuffer(data, "<u8" if wide else "<u4", n, at)
    at += docs.nbytes
    out["key"], out["doc"], out["pos"] = keys.view("<u8").ravel(), (docs.astype(np.uint64) + np.uint64(low & 0xFFFFFFFFFFFFFFFF)).view(np.int64), np.frombuffer(data, "<u4", n, at)
    return out


Packed = list[tuple[int, int, int, bytes]]


def _dealt(rows: np.ndarray, by: np.ndarray, buckets: int, kind: int, mark: int = 0) -> Packed:
    bucket = (by % np.uint64(buckets)).astype(np.int64)
    rows = rows[np.argsort(bucket, kind="stable")]
    bounds = np.searchsorted(np.sort(bucket), np.arange(buckets + 1)).tolist()
    pack = seeds_bytes if rows.dtype == SEED else np.ndarray.tobytes
    return [(kind, i, mark, pack(rows[s:e])) for i, (s, e) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if e > s]


def _by_pair(m: np.ndarray, buckets: int) -> Packed:
    return _dealt(m, mix(m["doc"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + m["head"].astype(np.uint64)), buckets, MATCHES)


def _by_doc(rows: np.ndarray, buckets: int, kind: int = PLACES, mark: int = 0) -> Packed:
    rows = rows[np.lexsort((rows["pos"], rows["doc"]))]
    return _dealt(rows, (rows["doc"] & LOW_BITS).astype(np.uint64), buckets, kind, mark)


def _batch(parts: Packed) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in parts], t) for i, t in enumerate(kinds)], names=["kind", "bucket", "mark", "rows"])


def _local(s: np.ndarray, mark: int, buckets: int) -> pa.RecordBatch:
    """What a batch of rows sends of its seeds: the first document of each, and the others where there are some.

    The keys of seeds that several documents hold are marked by the batch's mark, others by 0, so that the head comes back.
    """
    s = _sorted(s)
    if not len(s):
        return _batch([])
    start, group, mine = _groups(s)
    others = np.add.reduceat((~mine).astype(np.int64), start)[group] > 0
    return _batch(_dealt(s[mine & ~others], s["key"][mine & ~others], buckets, FIRSTS) + _dealt(s[mine & others], s["key"][mine & others], buckets, FIRSTS, mark) + [(OTHERS, mark % buckets, mark, seeds_bytes(s[~mine]))] * bool((~mine).any()))


def _mark(ids: np.ndarray, salt: int) -> int:
    """A number for a batch of rows, never 0."""
    total = int(mix(ids.astype(np.uint64) + np.uint64(salt)).sum()) ^ len(ids)
    return (total & LOW_BITS) | 1


def _runs_of(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[list[tuple[int, int, bytes]]]:
    """(kind, mark, rows) of each bucket or mark in turn, from batches sorted by it."""
    held, now = [], None
    for b in batches:
        for key, kind, mark, rows in zip(*[b.column(c).to_pylist() for c in (by, "kind", "mark", "rows")], strict=True):
            if held and key != now:
                yield held
                held = []
            now = key
            held.append((kind, mark, rows))
    if held:
        yield held


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The MATCH rows of each bucket in turn, from batches sorted by bucket."""
    held, now = [], None
    for b in batches:
        for bucket, rows in zip(b.column("bucket").to_pylist(), b.column("rows").to_pylist(), strict=True):
            if held and bucket != now:
                yield np.concatenate(held)
                held = []
            now = bucket
            held.append(np.frombuffer(rows, MATCH))
    if held:
        yield np.concatenate(held)


def _across(firsts: DataFrame, buckets: int, n: int, flags: bool) -> DataFrame:
    """The matches of the first documents of all batches, heads for the batches that need them, and, if flags, shared places."""

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, places, heads, seen = [], ([], []), [], 0

        def packed() -> pa.RecordBatch:
            m = np.concatenate([np.zeros(0, MATCH), *found])
            shared = [x for i in (0, 1) for x in _by_doc(np.concatenate([np.zeros(0, SEED), *places[i]]), buckets, mark=i)]
            return _batch(_by_pair(m if flags else merged(m), buckets) + shared + heads)

        for group in _runs_of(batches, "bucket"):  # buckets are packed together, so that there are few rows
            each = [(mark, seeds_of(rows)) for _, mark, rows in group]
            s = _sorted(np.concatenate([x for _, x in each]))
            start, number, mine = _groups(s)
            found.append(matched(s, n))
            back = [(mark, x) for mark, x in each if mark]
            at = np.searchsorted(s["key"][start], np.concatenate([np.zeros(0, np.uint64), *[x["key"] for _, x in back]]))
            if back:
                # each key's head, with all its places, to each batch that asks for it
                marks = np.repeat(np.array([mark for mark, _ in back], np.int64), [len(x) for _, x in back])
                asks = np.unique(np.stack([marks, at]), axis=1)
                held = np.add.reduceat(mine.astype(np.int64), start)[asks[1]]
                ends = np.cumsum(held)
                rows = s[np.repeat(start[asks[1]] - ends + held, held) + np.arange(ends[-1])]
                edges = np.flatnonzero(np.diff(asks[0])) + 1
                for mark, i, j in zip(asks[0][[0, *edges]].tolist(), [0, *ends[edges - 1].tolist()], [*ends[edges - 1].tolist(), len(rows)], strict=True):
                    heads.append((HEADS, mark % buckets, mark, seeds_bytes(rows[i:j])))
                seen += len(rows)
            if flags:
                shared = np.add.reduceat((~mine).astype(np.int64), start) > 0
                shared[at] = True
                places[0].append(s[shared[number] & ~mine])
                places[1].append(s[shared[number] & mine])  # the heads are marked
            seen += len(s)
            if seen > PACKED:
                yield packed()
                found, places, heads, seen = [], ([], []), [], 0
        if found:
            yield packed()

    return map_arrow(firsts.repartition(buckets, "bucket").sortWithinPartitions("bucket"), across, PACKED_SCHEMA)


def _settled(rows: DataFrame, buckets: int, n: int, flags: bool) -> DataFrame:
    """The matches of the other documents of a batch with the heads sent back to it, and, if flags, their places."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs_of(batches, "mark"):
            others = [seeds_of(x) for kind, _, x in group if kind == OTHERS]
            if not others:
                continue
            others = np.concatenate(others)
            m = matched(_sorted(np.concatenate([others, *[seeds_of(x) for kind, _, x in group if kind == HEADS]])), n)
            yield _batch(_by_pair(m if flags else merged(m), buckets) + (_by_doc(others, buckets) if flags else []))

    return map_arrow(rows.repartition(buckets, "bucket").sortWithinPartitions("mark"), settle, PACKED_SCHEMA)


def _met(sent: DataFrame, buckets: int, n: int, flags: bool) -> DataFrame:
    """Matches and places of what _local() has sent; with flags they are written, and what was sent goes."""
    first = cut(_across(sent.filter(F.col("kind") == FIRSTS), buckets, n, flags))
    back = sent.filter(F.col("kind") == OTHERS).unionByName(first.filter(F.col("kind") == HEADS))
    settled = _settled(back, buckets, n, flags)
    if flags:  # read several times
        settled = cut(settled)
        drop(sent)
    return first.filter(F.col("kind").isin(MATCHES, PLACES)).unionByName(settled)


def matches(docs: DataFrame, text: str, k: int, spread: int, min_words: int, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Packed MATCH rows (bucket, rows), dealt by pair of documents, and the packed places of shared seeds, dealt by document."""
    rows = docs.filter(F.col("doc_id").isNotNull() & F.col(text).isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_numpy(), b.column(1)
            found = [seeds(texts.slice(i, j - i), ids[i:j], k, spread) for i, j in portions(texts)]
            yield _local(np.concatenate([np.zeros(0, SEED), *found]), _mark(ids, 1), buckets)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, flags = None, [], None
        for b in batches:
            bucket, last = b.column("bucket").to_numpy(), b.column("last").to_numpy()
            edges = np.flatnonzero((bucket[1:] != bucket[:-1]) | (last[1:] != last[:-1])) + 1
            for i, j in zip([0, *edges.tolist()], [*edges.tolist(), len(bucket)], strict=True):
                if i == j:
                    continue
                if bucket[i] != now:
                    now, held, flags = bucket[i], [], None
                if not last[i]:
                    held += [seeds_of(x) for x in b.column("rows").slice(i, j - i).to_pylist()]
                    continue
                if flags is None:
                    flags = np.concatenate([np.zeros(0, SEED), *held])
                    flags, held = flags[np.argsort(flags["doc"], kind="stable")], []
                ids, texts = b.column("doc_id").slice(i, j - i).to_numpy(), b.column("text").slice(i, j - i)
                found = [windows(texts.slice(x, y - x), ids[x:y], flags, min_words, k, spread) for x, y in portions(texts)]
                yield _local(np.concatenate([np.zeros(0, SEED), *found]), _mark(ids, 2), buckets)

    seeded = _met(cut(map_arrow(rows, within, PACKED_SCHEMA)), buckets, k, True)
    none = F.lit(None)
    texts = rows.select(F.pmod(F.col("doc_id").bitwiseAND(F.lit(LOW_BITS)), F.lit(buckets)).cast("int").alias("bucket"), F.lit(1).alias("last"), none.cast("binary").alias("rows"), "doc_id", "text")
    flagged = seeded.filter(F.col("kind") == PLACES).select("bucket", F.lit(0).alias("last"), "rows", none.cast("long").alias("doc_id"), none.cast("string").alias("text"))
    both = flagged.unionByName(texts).repartition(buckets, "bucket").sortWithinPartitions("bucket", "last")
    verbatim = _met(cut(map_arrow(both, whole, PACKED_SCHEMA)), buckets, min_words, False)
    return seeded.unionByName(verbatim).filter(F.col("kind") == MATCHES).select("bucket", "rows"), seeded.filter(F.col("kind") == PLACES)


def _spans(found: DataFrame, buckets: int) -> DataFrame:
    """The words that passages cover, packed and dealt by document."""

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, other, start, n, at, size = [x.to_numpy() for x in b.columns]
            s = np.zeros(2 * len(doc), SPAN)
            s["doc"], s["pos"], s["n"] = np.concatenate([doc, other]), np.concatenate([start, at]), np.concatenate([n, size])
            yield _batch(_by_doc(np.unique(s), buckets, SPANS))

    return map_arrow(found.select("doc_id", "other_id", "start", "n_words", "other_start", "other_words"), spans, PACKED_SCHEMA)


def _seeds_in(group: list[tuple[int, int, bytes]], kind: int, mark: int) -> np.ndarray:
    return np.concatenate([np.zeros(0, SEED), *[seeds_of(x) for k, m, x in group if k == kind and m == mark]])


def _spans_in(group: list[tuple[int, int, bytes]]) -> np.ndarray:
    return np.concatenate([np.zeros(0, SPAN), *[np.frombuffer(x, SPAN) for kind, _, x in group if kind == SPANS]])


def matches_left(places: DataFrame, found: DataFrame, k: int, buckets: int) -> DataFrame:
    """Packed MATCH rows of the places of shared seeds that no passage of their document covers, and of those seeds that several
    documents are left with the places, dealt by document; of the seeds of more than ALL documents they are marked."""

    def uncovered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = ([], []), 0

        def packed() -> pa.RecordBatch:
            heads, others = np.concatenate(held[1]), np.concatenate(held[0])
            return _batch(_dealt(heads, heads["key"], buckets, HEADS) + _dealt(others, others["key"], buckets, PLACES))

        for group in _runs_of(batches, "bucket"):  # buckets are packed together, so that there are few rows
            spans = _spans_in(group)
            for i in (0, 1):
                held[i].append(left(_seeds_in(group, PLACES, i), spans))
                count += len(held[i][-1])
            if count > PACKED:
                yield packed()
                held, count = ([], []), 0
        if held[0]:
            yield packed()

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = ([], []), 0

        def packed() -> pa.RecordBatch:
            return _batch([x for i in (0, 1) for x in _by_doc(np.concatenate(held[i]), buckets, mark=i)])

        for group in _runs_of(batches, "bucket"):
            heads = np.concatenate([np.zeros(0, SEED), *[seeds_of(x) for kind, _, x in group if kind == HEADS]])
            others = [seeds_of(x) for kind, _, x in group if kind == PLACES]
            s = _sorted(np.concatenate([heads, *others]))
            for m in met_again(s, heads, k):
                yield _batch(_by_pair(m, buckets))
            if len(s):
                start, number, _ = _groups(s)
                turn = np.ones(len(s), bool)
                turn[1:] = (s["key"][1:] != s["key"][:-1]) | (s["doc"][1:] != s["doc"][:-1])
                docs = np.add.reduceat(turn.astype(np.int64), start)[number]
                held[0].append(s[(docs > 1) & (docs <= ALL)])
                held[1].append(s[docs > ALL])
                count += len(held[0][-1]) + len(held[1][-1])
            if count > PACKED:
                yield packed()
                held, count = ([], []), 0
        if held[0]:
            yield packed()

    rest = map_arrow(places.unionByName(_spans(found, buckets)).repartition(buckets, "bucket").sortWithinPartitions("bucket"), uncovered, PACKED_SCHEMA)
    return map_arrow(rest.repartition(buckets, "bucket").sortWithinPartitions("bucket"), again, PACKED_SCHEMA)


def matches_joint(docs: DataFrame, places: DataFrame, found: DataFrame, k: int, min_words: int, identity: float, buckets: int) -> DataFrame:
    """Packed MATCH rows (bucket, rows) of documents that share two seeds, at least one of them frequent.

    places: those of matches_left(). found: the passages of its matches; pairs whose two places they cover in both documents are
    left out, as in step 6.
    """
    reach = max(0, 2 * min_words - k)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for group in _runs_of(batches, "bucket"):
            each = [_seeds_in(group, PLACES, i) for i in (0, 1)]
            s, often = np.concatenate(each), np.repeat([False, True], [len(x) for x in each])
            by = np.lexsort((s["pos"], s["doc"]))
            s, often = s[by], often[by]
            held.append(joint(s, often, covered(s, _spans_in(group)), k))
            count += len(held[-1])
            if count > PACKED:
                x = np.concatenate(held)
                yield _batch(_dealt(x, x["key"], buckets, JOINTS))
                held, count = [], 0
        if held:
            x = np.concatenate(held)
            yield _batch(_dealt(x, x["key"], buckets, JOINTS))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many, count = [], [], 0

        def packed() -> pa.RecordBatch:
            return _batch(_by_pair(np.concatenate([np.zeros(0, MATCH), *held]), buckets) + _by_doc(np.concatenate(many), buckets, JOINTS))

        for group in _runs_of(batches, "bucket"):
            m, x = joint_met(np.concatenate([np.frombuffer(x, JOINT) for _, _, x in group]), k)
            held += m
            many.append(x)
            count += len(x) + sum(map(len, m))
            if count > PACKED:
                yield packed()
                held, many, count = [], [], 0
        if many:
            yield packed()

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows in b.column("rows").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.frombuffer(rows, JOINT)["doc"]))], names=["doc_id"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, texts = b.column(0).to_numpy(), b.column(1)
            for i, j in portions(texts):
                h, first = words(texts.slice(i, j - i))
                h = (h >> np.uint64(48)).astype("<u2")
                yield _batch([(HASHES, (d & LOW_BITS) % buckets, d, h[x:y].tobytes()) for d, x, y in zip(doc[i:j].tolist(), first[:-1].tolist(), first[1:].tolist(), strict=True)])

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, bytes]]] = {}
        size = 0

        def packed() -> pa.RecordBatch:
            parts = [(i, [x for x, _ in rows], [w for _, w in rows]) for i, rows in held.items()]
            return _batch([(JOINTS, i, 0, np.array([len(x)], "<i8").tobytes() + np.array(x, NEAR).tobytes() + b"".join(w)) for i, x, w in parts])

        for group in _runs_of(batches, "bucket"):
            x = np.concatenate([np.zeros(0, JOINT), *[np.frombuffer(rows, JOINT) for kind, _, rows in group if kind == JOINTS]])
            x = x[np.argsort(x["doc"], kind="stable")]
            for kind, doc, rows in group:
                if kind != HASHES:
                    continue
                h, seen, kept = np.frombuffer(rows, "<u2"), set(), []
                for row in x[np.searchsorted(x["doc"], doc) : np.searchsorted(x["doc"], doc, "right")].tolist():
                    key, _, pos, after, done = row[:5]
                    near = h[max(0, pos - reach) : after + k + reach].tobytes()
                    # else within a run of one line or word; near the front of a text other places can have the same words around
                    if (key, done, min(pos, reach), near) not in seen:
                        seen.add((key, done, min(pos, reach), near))
                        kept.append(row)
                for key, _, pos, after, done, tile, tiles, times, step in repeated(kept, k, 2 * min_words):
                    near = h[max(0, pos - reach) : after + (times - 1) * step + k + reach].tobytes()
                    for other in range(tiles):
                        a, b = min(tile, other), max(tile, other)
                        to = int(mix(np.array([key + 0x9E3779B97F4A7C15 * (a << 16 | b) & 0xFFFFFFFFFFFFFFFF], np.uint64))[0] % np.uint64(buckets))
                        held.setdefault(to, []).append(((key, doc, pos, after, done, tile, a, b, len(near) // 2, times, step), near))
                        size += len(near)
            if size > 4 * PACKED:
                yield packed()
                held, size = {}, 0
        if held:
            yield packed()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for group in _runs_of(batches, "bucket"):
            rows, near = [], []
            for _, _, x in group:
                n = int(np.frombuffer(x, "<i8", 1)[0])
                rows.append(np.frombuffer(x, NEAR, n, 8))
                near.append(np.frombuffer(x, "<u2", -1, 8 + n * NEAR.itemsize))
            rows, near = np.concatenate(rows), np.concatenate(near)
            begin = np.cumsum(rows["n"], dtype=np.int64) - rows["n"]
            by = np.lexsort((rows["pos"], rows["doc"], rows["b"], rows["a"], rows["key"]))
            rows, begin = rows[by], begin[by]
            kind = rows[["key", "a", "b"]]
            edges = np.flatnonzero(kind[1:] != kind[:-1]) + 1
            for i, j in zip([0, *edges.tolist()], [*edges.tolist(), len(rows)], strict=True):
                n = rows["n"][i:j].astype(np.int64)
                place = np.repeat(begin[i:j] - np.cumsum(n) + n, n) + np.arange(n.sum())
                pairs = alike(rows[i:j], near[place], min_words, identity)
                for c in range(0, len(pairs), 2048):
                    held.append(laid(*rows[i:j][pairs[c : c + 2048].T], k))
                    count += len(held[-1])
                    if count > PACKED // 2:
                        yield _batch(_by_pair(np.concatenate(held), buckets))
                        held, count = [], 0
        if held:
            yield _batch(_by_pair(np.concatenate(held), buckets))

    def by_bucket(df: DataFrame, *more: str) -> DataFrame:
        return df.repartition(buckets, "bucket").sortWithinPartitions("bucket", *more)

    both = map_arrow(by_bucket(places.unionByName(_spans(found, buckets))), joined, PACKED_SCHEMA)
    met = cut(map_arrow(by_bucket(both), meet, PACKED_SCHEMA))
    many = met.filter(F.col("kind") == JOINTS)
    wanted = cut(map_arrow(many, ids, "doc_id long").distinct())
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    texts = map_arrow(docs.join(wanted, "doc_id", "left_semi").select("doc_id", "text"), hashed, PACKED_SCHEMA)
    close = map_arrow(by_bucket(map_arrow(by_bucket(many.unionByName(texts)), around, PACKED_SCHEMA)), compare, PACKED_SCHEMA)
    return met.filter(F.col("kind") == MATCHES).unionByName(close).select("bucket", "rows")


class Fenwick:
    """Maxima of (score, item) over prefixes of places."""

    def __init__(self, n: int):
        self.best: list[tuple[float, int]] = [(0.0, -1)] * (n + 1)

    def put(self, place: int, score: float, item: int) -> None:
        place += 1
        while place < len(self.best):
            if score > self.best[place][0]:
                self.best[place] = (score, item)
            place += place & -place

    def top(self, n: int) -> tuple[float, int]:
        """Over the first n places."""
        found = (0.0, -1)
        while n:
            if self.best[n][0] > found[0]:
                found = self.best[n]
            n -= n & -n
        return found


def chains(runs: list[tuple[int, int, int]], cost: float = GAP_COST) -> list[list[tuple[int, int, int]]]:
    """Collinear chains of runs (place, place in the head, length); every run is in one chain.

    Of two runs the later begins after the start of the earlier in both documents and after its end in one of them; an overlap
    is cut off its front. The score is the length of the runs less cost times the words between them.
    """
    if len(runs) == 1:
        return [runs]
    runs = sorted(set(runs))
    ends = sorted({at + n for _, at, n in runs})
    tree = Fenwick(len(ends))
    by_end = sorted(range(len(runs)), key=lambda i: runs[i][0] + runs[i][2])
    score, before, done = [0.0] * len(runs), [-1] * len(runs), 0
    for i, (p, a, n) in enumerate(runs):
        while done < len(by_end) and runs[by_end[done]][0] + runs[by_end[done]][2] <= p:
            j = by_end[done]
            q, b, m = runs[j]
            # place-independent form of the score, as the gap's cost is linear
            tree.put(bisect_right(ends, b + m) - 1, score[j] + cost * (q + m + b + m), j)
            done += 1
        best, j = tree.top(bisect_right(ends, a))
        gain = best - cost * (p + a)
        score[i], before[i] = n + max(0.0, gain), j if gain > 0 else -1
    used, out = [False] * len(runs), []
    for i in sorted(range(len(runs)), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(runs[i])
            i = before[i]
        if chain:
            out += _split(chain[::-1])
    return out


def _split(chain: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The parts of a chain between gaps of more than MAX_GAP words."""
    out = [[chain[0]]]
    for x, y in zip(chain, chain[1:], strict=False):
        if max(y[0] - x[0], y[1] - x[1]) - x[2] > MAX_GAP:
            out.append([])
        out[-1].append(y)
    return out


def _runs(m: np.ndarray) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
    """(doc, head, runs of equal words) of MATCH rows, pair by pair."""
    diagonal = m["pos"] - m["at"]
    m = m[np.lexsort((m["pos"], diagonal, m["head"], m["doc"]))]
    if not len(m):
        return
    diagonal = m["pos"] - m["at"]
    pair = np.ones(len(m), bool)
    pair[1:] = (m["doc"][1:] != m["doc"][:-1]) | (m["head"][1:] != m["head"][:-1])
    same = ~pair
    same[1:] &= diagonal[1:] == diagonal[:-1]
    reach = m["pos"] + m["n"]
    # a seed that touches the one before goes on its run
    goes_on = same.copy()
    line = np.cumsum(~same) << 33  # the furthest reach so far on each diagonal, as a window holds many seeds
    goes_on[1:] &= m["pos"][1:] <= (np.maximum.accumulate(reach + line) - line)[:-1]
    starts = np.flatnonzero(~goes_on)
    stops = np.maximum.reduceat(reach, starts)
    rows = np.stack([m["pos"][starts], m["at"][starts], stops - m["pos"][starts]], axis=1)
    bounds = np.searchsorted(starts, np.flatnonzero(pair))
    docs, heads = m["doc"][pair].tolist(), m["head"][pair].tolist()
    for d, h, s, e in zip(docs, heads, bounds.tolist(), [*bounds[1:].tolist(), len(rows)], strict=True):
        yield d, h, [tuple(x) for x in rows[s:e].tolist()]


def _trimmed(chain: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The runs without overlaps in either document."""
    out = [chain[0]]
    for p, a, n in chain[1:]:
        q, b, m = out[-1]
        over = max(q + m - p, b + m - a, 0)
        if n > over:
            out.append((p + over, a + over, n - over))
    return out


def _ranges(chain: list[tuple[int, int, int]], side: int, margin: int) -> list[tuple[int, int]]:
    """The places whose words the alignment needs: before, between and after the runs."""
    first = chain[0][side]
    out = [(max(0, first - margin), first)]
    for x, y in zip(chain, chain[1:], strict=False):
        out.append((x[side] + x[2], y[side]))
    last = chain[-1][side] + chain[-1][2]
    return [*out, (last, last + margin)]


def _gap(a: list[int], b: list[int]) -> tuple[int, int]:
    """(matches, errors) of an alignment of two short lists by edit distance."""
    if not a or not b:
        return 0, max(len(a), len(b))
    if len(a) == len(b):
        errors = sum(x != y for x, y in zip(a, b, strict=True))
        if errors <= 2:  # shifted alignments have two errors at least
            return len(a) - errors, errors
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    errors = row[-1]
    return max(0, max(len(a), len(b)) - errors), errors


def _followed(a: list[int], b: list[int], price: float) -> list[tuple[int, int]]:
    """Runs (distance, length) of equal words of two lists side by side, up to GIVE_UP errors below the best score.

    An error takes ``price`` from the score. What is of no use is left out later.
    """
    out, score, best, begin = [], 0.0, 0.0, None
    for i, (x, y) in enumerate(zip(a, b, strict=False)):
        if x == y:
            begin = i if begin is None else begin
            score += 1
            best = max(best, score)
        else:
            if begin is not None:
                out.append((begin, i - begin))
                begin = None
            score -= price
            if score < best - GIVE_UP * price:
                break
    if begin is not None:
        out.append((begin, min(len(a), len(b)) - begin))
    return out


def aligned(chain: list[tuple[int, int, int]], left: list[list[int]], right: list[list[int]], identity: float, least: int) -> list[tuple[int, int, int, int, int]]:
    """Passages (place, words, place in the head, words, matches) of a chain.

    left, right: the words of both documents in the ranges of _ranges(). A part counts if its errors are at most
    (1 - identity) of its words, ends with equal words, and has at least ``least`` words in both documents.
    """
    price = identity / (1 - identity)  # errors that a match makes up for
    runs = [tuple(x) for x in chain]
    gaps = [_gap(a, b) for a, b in zip(left[1:-1], right[1:-1], strict=True)]
    p, a, n = runs[0]
    before = [(p - i - m, a - i - m, m) for i, m in _followed(left[0][::-1], right[0][::-1], price)][::-1]
    q, c, m = runs[-1][0] + runs[-1][2], runs[-1][1] + runs[-1][2], 0
    after = [(q + i, c + i, m) for i, m in _followed(left[-1], right[-1], price)]
    runs, core = [*before, *runs, *after], len(before)
    # beyond the chain gaps are words that differ, side by side
    gaps = [gaps[i - core] if core <= i < core + len(gaps) else (0, y[0] - x[0] - x[2]) for i, (x, y) in enumerate(zip(runs, runs[1:], strict=False))]
    score = [n for _, _, n in runs]
    cost = [same - price * wrong for same, wrong in gaps]

    def passage(i: int, j: int) -> tuple[int, int, int, int, int] | None:
        p, a = runs[i][0], runs[i][1]
        size, across = runs[j][0] + runs[j][2] - p, runs[j][1] + runs[j][2] - a
        if min(size, across) >= least:
            return p, size, a, across, sum(score[i : j + 1]) + sum(same for same, _ in gaps[i:j])
        return None

    out, rest, last = [], [], 0
    for i, j in _stretches(score, cost):
        if found := passage(i, j):
            out.append(found)
            rest.append((last, i))
            last = j + 1
    # what lies between these can still be alike enough as a whole, though its score falls below 0 on the way
    todo = [*rest, (last, len(runs))]
    while todo:
        begin, end = todo.pop()
        if begin < end:
            i, j = _longest(runs, score, cost, begin, end)
            if found := passage(i, j):
                out.append(found)
                todo += [(begin, i), (j + 1, end)]
    return sorted(out)


def _stretches(score: list[int], cost: list[float]) -> Iterator[tuple[int, int]]:
    """(first, last) runs of stretches whose score no gap brings down to 0, up to where it is best."""
    i = 0
    while i < len(score):
        total, best, stop = 0.0, 0.0, i
        for j in range(i, len(score)):
            if j > i:
                total += cost[j - 1]
                if total <= 0:
                    break
            total += score[j]
            if total >= best:
                best, stop = total, j
        yield i, stop
        i = stop + 1


def _longest(runs: list[tuple[int, int, int]], score: list[int], cost: list[float], begin: int, end: int) -> tuple[int, int]:
    """The (first, last) of runs[begin:end] that span the most words with a score of 0 or more."""
    before, after, total = [], [], 0.0
    for i in range(begin, end):
        before.append(total)
        after.append(total + score[i])
        total += score[i] + (cost[i] if i + 1 < end else 0.0)
    # a later start is of use only if less is lost before it
    starts = [0]
    for i in range(1, end - begin):
        if before[i] < before[starts[-1]]:
            starts.append(i)
    best = (0, 0, 0)
    for j in range(end - begin - 1, -1, -1):
        while starts and (starts[-1] > j or after[j] >= before[starts[-1]] - 1e-9):
            i = starts.pop()
            if i <= j:
                best = max(best, (runs[begin + j][0] + runs[begin + j][2] - runs[begin + i][0], begin + i, begin + j))
    return best[1:] if best[0] else (begin, begin)


def passages(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS, identity: float = IDENTITY, k: int = K, spread: int = SPREAD) -> DataFrame:
    """Rows (doc_id, other_id, start, n_words, other_start, other_words, matches) of passages that repeat.

    Words are runs without white space, A-Z as a-z; places count words from 0. A passage has min_words words or more in both
    documents and at most 1 - identity of them differ. Each document is aligned with the heads of its seeds and windows, not
    with every document that holds the passage: for n documents of one passage there are about n rows, and doc_id and other_id
    together name all of them. Repeats within one document do not count, nor do those of rows with one doc_id. Rows whose doc_id
    or text is null, and empty texts, give nothing, as does an empty table. doc_id is an integer; other columns are not read,
    whatever their names. The rows do not depend on how docs is dealt. Rows that repeat a doc_id should repeat its text: places
    are those of the text that sorts first. Long texts are read whole, one batch of rows in memory.

    Every min_words words that stand verbatim in two documents are in a passage of each of them but the smallest doc_id,
    whatever parts of them other documents hold. A run of one repeated word or line that is longer than the head's is in several
    passages, each as long as the head's. Passages with differences are found by chance of their seeds; they are missed where they
    share fewer than EVIDENCE words in seeds. Where smaller documents hold fragments of them that are too short to count, so that
    their seeds have other heads, the seeds that no passage covers are met again, up to ALL documents a seed pair by pair,
    and of more each pair that shares two such seeds that do not overlap, if a passage can stand around these: one of up to
    2 * min_words words that holds one of the seeds is met, of a longer one a stretch of min_words words or more that is alike
    enough must lie within 2 * min_words words of them. Of the places of a seed that a passage of step 5 covers none are met
    again, also not with places of other documents that no passage covers.
    """
    buckets = parts_of(docs.select("doc_id", text))
    docs = docs.filter(F.col("doc_id").isNotNull() & F.col(text).isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    found, places = matches(docs, "text", k, spread, min_words, buckets)
    first = cut(_aligned(docs, found, min_words, identity, buckets))
    rest = cut(matches_left(places, first, k, buckets))
    again = cut(_aligned(docs, rest.filter(F.col("kind") == MATCHES).select("bucket", "rows"), min_words, identity, buckets))
    more = matches_joint(docs, rest.filter(F.col("kind") == PLACES), again, k, min_words, identity, buckets)
    # two chains of a pair can grow into one passage
    return first.unionByName(again).unionByName(_aligned(docs, more, min_words, identity, buckets)).distinct()


def _aligned(docs: DataFrame, found: DataFrame, min_words: int, identity: float, buckets: int) -> DataFrame:
    """The passages of packed MATCH rows; of two chains of a pair that grow into one passage it comes twice."""

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _by_bucket(batches):
            rows = []
            for doc, head, runs in _runs(unmet(group)):
                for c in chains(runs):
                    c = _trimmed(c)
                    if sum(x[2] for x in c) >= EVIDENCE and min(c[-1][0] - c[0][0], c[-1][1] - c[0][1]) + c[-1][2] + 2 * MARGIN >= min_words:
                        rows.append((doc, head, np.array(c, "<i4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["doc", "head", "runs"])

    made = map_arrow(found.repartition(buckets, "bucket").sortWithinPartitions("bucket"), chain, "doc long, head long, runs binary")
    made = cut(made.withColumn("id", F.sha2(F.concat_ws(",", "doc", "head", F.hex("runs")), 256)))
    asked = made.select(F.col("doc").alias("doc_id"), "id", F.lit(0).alias("side"), "runs").unionByName(made.select(F.col("head").alias("doc_id"), "id", F.lit(1).alias("side"), "runs"))
    ids = cut(asked.groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", F.ceil(F.col("n") / F.lit(REQUESTS)).cast("int").alias("copies")))
    # a text that many passages ask for is answered by several tasks
    if ids.count() <= BROADCAST_ROWS:
        wanted = hot = F.broadcast(ids)
    else:
        wanted, hot = ids, ids.filter("copies > 1")
        hot = F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot
    asked = asked.join(hot, "doc_id", "left").withColumn("copy", F.pmod(F.xxhash64("id"), F.coalesce("copies", F.lit(1))).cast("int")).drop("copies")
    texts = docs.join(wanted, "doc_id").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    none = F.lit(None)
    both = texts.select("doc_id", "copy", F.lit("").alias("id"), F.lit(-1).alias("side"), none.cast("binary").alias("runs"), "text").unionByName(asked.withColumn("text", none.cast("string")))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h = None, np.zeros(0, np.uint64)
        for b in batches:
            rows = []
            side = b.column("side").to_pylist()
            given = np.flatnonzero(np.array(side) == -1)
            hashes, first = words(b.column("text").take(pa.array(given)))
            place = dict(zip(given.tolist(), range(len(given)), strict=True))
            for i, (doc, copy, key, s, runs) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("copy").to_pylist(), b.column("id").to_pylist(), side, b.column("runs").to_pylist(), strict=True)):
                if s == -1:
                    if (doc, copy) != now:  # of rows with one doc_id the first
                        now, h = (doc, copy), hashes[first[place[i]] : first[place[i] + 1]].copy()
                    continue
                parts = [h[x:y] for x, y in _ranges(np.frombuffer(runs, "<i4").reshape(-1, 3).tolist(), s, MARGIN)]
                rows.append((key, s, doc, runs if s == 0 else None, np.array([len(x) for x in parts], "<i4").tobytes(), (np.concatenate(parts) >> np.uint64(32)).astype("<u4").tobytes()))
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in rows], t) for j, t in enumerate(kinds)], names=["id", "side", "doc_id", "runs", "sizes", "words"])

    dealt = both.repartition(buckets, "doc_id", "copy").sortWithinPartitions("doc_id", "copy", "side", "text")
    answers = cut(map_arrow(dealt, answer, "id string, side int, doc_id long, runs binary, sizes binary, words binary"))
    drop(made)
    pairs = answers.filter("side = 0").drop("side").join(answers.filter("side = 1").select("id", F.col("doc_id").alias("other_id"), F.col("sizes").alias("sizes2"), F.col("words").alias("words2")), "id").drop("id")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts(sizes: bytes, held: bytes) -> list[list[int]]:
            out, at, every = [], 0, np.frombuffer(held, "<u4").tolist()
            for size in np.frombuffer(sizes, "<i4").tolist():
                out.append(every[at : at + size])
                at += size
            return out

        for b in batches:
            rows = []
            for doc, other, runs, s1, w1, s2, w2 in zip(*[b.column(c).to_pylist() for c in ("doc_id", "other_id", "runs", "sizes", "words", "sizes2", "words2")], strict=True):
                chain_ = np.frombuffer(runs, "<i4").reshape(-1, 3).tolist()
                rows += [(doc, other, *x) for x in aligned(chain_, parts(s1, w1), parts(s2, w2), identity, min_words)]
            names = ["doc_id", "other_id", "start", "n_words", "other_start", "other_words", "matches"]
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in rows], pa.int64()) for j in range(7)], names=names)

    return map_arrow(pairs, align, "doc_id long, other_id long, start long, n_words long, other_start long, other_words long, matches long")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
