"""Held-out passages inside a corpus, also edited, partial and reordered in layout.

Texts become words free of case, punctuation, markup and invisible characters,
and these become numbers. Word n-grams that are rare among all the different
passages are the seeds, and where a stretch of a passage has few of them its least
frequent ones. A join on the n-grams' numbers brings passages and texts together;
before it, a bitmap of the seeds drops the texts that cannot hold enough of them.
The bitmap has a greatest size at any number of test items: when full it drops less,
and the join decides all the same. Nothing of the corpus but such texts is
shuffled. Where enough seeds lie along one stretch of a text, Smith-Waterman
alignment with affine gaps scores the stretch, many at a time, and the share of
the passage's words that the best alignment covers, edited ones among them, decides.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.runtime import materialize

GRAM = 3  # words of a seed
RARE = 4  # different passages that may share a seed
POOR, WINDOW_SEEDS = 8, 16  # a stretch of the share asked for with fewer seeds than the first gets its least frequent n-grams, up to the second
SEEDS = 4  # distinct seeds of one item that a stretch must hold at least,
SEED_SHARE = 0.3  # and this part of the seeds in the poorest stretch of the share asked for
SCALE = 10  # scores are whole numbers of tenths
MATCH, MISS, OPEN, EXTEND = 20, -20, -30, -1
EDITS = 1 / 8  # words of a repeated passage that may be changed
EDGE = 2  # changed words that may lie at the ends of a stretch
DENSITY = 0.8  # part of a share's least score that must be reached before its words are counted
FOREIGN = (4, 40)  # words of the foreign sentence that may stand in between
MOST_BITS = 2**29  # of the bitmap: 64 MB
BITS_A_SEED = 64
CELLS = 40_000  # of one row of all alignments that are worked on together
STOP, DIAGONAL, UP, LEFT = range(4)
GREW, OPENED, BARE_UP = 4, 8, 16  # further marks of a cell: see _fill
NO_WORD, NO_TEXT = 2**40, 2**41  # fill up passages, texts to one length

_MARKUP = re.compile(r"<[^<>]{1,200}>|&lt;/?[a-z][^&]{0,100}&gt;|\[/?[a-zA-Z]+(?:=[^\]]{0,100})?\]|\]\([^)\s]{0,200}\)", re.I)
_UNSEEN = regex.compile(r"[\p{Cf}\p{Mn}]+")
_WORD = re.compile(r"[^\W_]+")
_APART = re.compile(r"(?<=[぀-ヿ㐀-鿿])(?=[぀-ヿ㐀-鿿])")
_KNOWN_WORDS = 1_000_000  # words whose number a worker remembers
_numbers: dict[str, int] = {}


def words(text: str) -> list[str]:
    """Comparable words: scripts without blanks give single characters."""
    if "<" in text or "[" in text or "](" in text or "&" in text:
        text = html.unescape(html.unescape(_MARKUP.sub(" ", html.unescape(text))))
    if not text.isascii():
        text = _UNSEEN.sub("", unicodedata.normalize("NFKC", text)).casefold()
        return _WORD.findall(_APART.sub(" ", text) if _APART.search(text) else text)
    return _WORD.findall(text.lower())


def numbers(found: list[str]) -> np.ndarray:
    """A 64-bit number for each word."""
    if len(_numbers) > _KNOWN_WORDS:
        _numbers.clear()
    known = _numbers.get
    out = [known(w) for w in found]
    for i, x in enumerate(out):
        if x is None:
            out[i] = _numbers[found[i]] = xxhash.xxh3_64_intdigest(found[i])
    return np.array(out, np.uint64)


def grams(w: np.ndarray) -> np.ndarray:
    """One 64-bit number for each n-gram of word numbers."""
    n = len(w) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(GRAM):
        out = (out + w[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out


def _short(w: np.ndarray) -> np.ndarray:
    """Word numbers as alignments compare them, in 32 bits."""
    return (w >> np.uint64(32)).astype(np.uint32).view(np.int32)


# --- seeds ---------------------------------------------------------------------------------


def _passages(items: DataFrame) -> DataFrame:
    """``item, p, w, g``: number of the passage, its words, its n-grams."""

    def run(frames):
        for pdf in frames:
            out = []
            for i, t in zip(pdf["i"].tolist(), pdf["p"]):
                w = numbers(words(t))
                if len(w) >= SEEDS + GRAM - 1:
                    p = xxhash.xxh3_64_intdigest(w.tobytes()) - 2**63
                    out.append((i, p, _short(w), grams(w).view(np.int64)))
            yield pd.DataFrame(out, columns=["item", "p", "w", "g"])

    return items.mapInPandas(run, "item bigint, p bigint, w array<int>, g array<bigint>")


def _pick(share: float):
    """The seeds of one passage, and how many a stretch of a text must hold."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        often = pdf["often"].to_numpy()
        keep = often <= RARE
        wide = math.ceil(share * len(pdf))
        for k in range(len(pdf) - wide + 1):
            if (has := int(keep[k : k + wide].sum())) < min(wide, POOR):
                rest = k + np.flatnonzero(~keep[k : k + wide])
                keep[rest[np.argsort(often[rest], kind="stable")[: WINDOW_SEEDS - has]]] = True
        total = np.r_[0, np.cumsum(keep)]
        pdf["need"] = max(SEEDS, math.ceil(SEED_SHARE * int((total[wide:] - total[:-wide]).min())))
        pdf["n"] = len(pdf) + GRAM - 1
        return pdf.loc[keep, ["p", "at", "g", "need", "n"]]

    return run


def seeds_of(passages: DataFrame, share: float) -> DataFrame:
    """``p, at, g, need, n``: the seeds of the different passages (p, g), how many
    of them a stretch must hold, and the passage's length in words. An n-gram's
    rarity is the number of passages that hold it, of all passages."""
    each = passages.select("p", F.posexplode("g").alias("at", "g"))
    often = each.select("p", "g").distinct().groupBy("g").agg(F.count(F.lit(1)).alias("often"))
    return each.join(often, "g").groupBy("p").applyInPandas(_pick(share), "p bigint, at int, g bigint, need int, n int")


def _bit_places(g: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    g = g.view(np.uint64)
    mask = np.uint64(bits - 1)
    return (g & mask).astype(np.int64), (((g >> np.uint64(33)) ^ (g >> np.uint64(13))) & mask).astype(np.int64)


def _bitmap(seeds: DataFrame, bits: int) -> np.ndarray:
    """Two bits for each seed. Parts are put together by tasks; the driver gets
    ``bits`` / 8 bytes, however many seeds there are."""
    part = min(bits, 2**20)

    def mark(frames):
        held: dict[int, np.ndarray] = {}
        for pdf in frames:
            for at in _bit_places(pdf["g"].to_numpy(), bits):
                for block in np.unique(at // part).tolist():
                    own = at[at // part == block] % part
                    held.setdefault(block, np.zeros(part, bool))[own] = True
                    if len(held) >= 64:
                        yield from packed(held)
        yield from packed(held)

    def packed(held):
        while held:
            block, own = held.popitem()
            yield pd.DataFrame({"block": [block], "bits": [np.packbits(own, bitorder="little").tobytes()]})

    def either(pdf: pd.DataFrame) -> pd.DataFrame:
        got = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in pdf["bits"]])
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "bits": [got.tobytes()]})

    blocks = seeds.select("g").mapInPandas(mark, "block int, bits binary").groupBy("block").applyInPandas(either, "block int, bits binary")
    out = np.zeros(bits // 8, np.uint8)
    for block, got in blocks.collect():  # at most MOST_BITS
        out[block * part // 8 : (block + 1) * part // 8] = np.frombuffer(got, np.uint8)
    return out


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(values))


def _sift(table, bits: int, need: int, reach: int):
    """Texts of which some stretch may hold ``need`` seeds, with their words and
    the n-grams that may be seeds; the texts of a batch are worked on together."""

    def run(batches):
        from pyspark import TaskContext

        bitmap = table.value
        task, nth = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            found = [words(t) for t in batch["t"].to_pylist()]
            size = np.array([len(f) for f in found], np.int64)
            w = numbers([x for f in found for x in f])
            g = grams(w)
            if len(g) < need:
                continue
            row = np.repeat(np.arange(len(size)), size)  # of each word
            a, b = _bit_places(g, bits)
            maybe = (bitmap[a >> 3] >> (a & 7)) & (bitmap[b >> 3] >> (b & 7)) & 1
            hit = np.flatnonzero((maybe == 1) & (row[: len(g)] == row[GRAM - 1 :]))  # no n-gram of two texts
            if len(hit) < need:
                continue
            first, last = hit[: len(hit) - need + 1], hit[need - 1 :]
            keep = np.zeros(len(size), bool)
            keep[row[first[(row[first] == row[last]) & (last - first <= reach)]]] = True
            kept, hit = np.flatnonzero(keep), hit[keep[row[hit]]]
            start = np.cumsum(size) - size
            hits = np.bincount(row[hit], minlength=len(size))[kept]
            yield pa.RecordBatch.from_arrays(
                [pa.array(task + nth + np.arange(len(kept))), batch["doc"].take(pa.array(kept)), _lists(_short(w[keep[row]]), size[kept]),
                 _lists((hit - start[row[hit]]).astype(np.int32), hits), _lists(g[hit].view(np.int64), hits)],
                names=["uid", "doc", "w", "place", "g"],
            )
            nth += len(kept)

    return run


# --- alignment -----------------------------------------------------------------------------


def _fill(jobs: list[tuple[np.ndarray, np.ndarray]]):
    """Best local alignments of (passage, text) pairs: their scores, the cells in
    which they end, and the marks of all cells by passage word, pair and text word.

    A mark says how the cell is reached (STOP, DIAGONAL, UP, LEFT); BARE_UP: how
    without a gap to the left; GREW: a gap upwards through it opens in it; OPENED:
    a gap to the left through it opens just before it, as late as possible.
    """
    rows, cols, k = max(len(p) for p, _ in jobs), max(len(t) for _, t in jobs), len(jobs)
    passages, texts = np.full((rows, k), NO_WORD, np.int64), np.full((k, cols), NO_TEXT, np.int64)
    for n, (p, t) in enumerate(jobs):
        passages[: len(p), n] = p
        texts[n, : len(t)] = t
    h, e = np.zeros((k, cols + 1), np.int32), np.full((k, cols + 1), -(10**8), np.int32)
    ramp = np.arange(cols + 1, dtype=np.int32) * -EXTEND
    best, end = np.zeros(k, np.int32), np.zeros((k, 2), np.int64)
    marks = np.empty((rows, k, cols + 1), np.int8)
    new, gap = np.zeros((k, cols + 1), np.int32), np.full((k, cols + 1), -(10**8), np.int32)
    opened = np.zeros((k, cols + 1), bool)
    at = np.arange(k)
    for row in range(rows):
        # a gap in the text's favour: words of the passage left out
        fresh, on = h + OPEN, e + EXTEND
        grew = fresh > on
        e = np.maximum(fresh, on)
        new[:, 0] = 0
        new[:, 1:] = h[:, :-1] + np.where(texts == passages[row][:, None], np.int32(MATCH), np.int32(MISS))
        up = e > new
        np.maximum(new, e, out=new)
        # words of the text passed over: best start of a gap to the left
        lead = new + ramp
        top = np.maximum.accumulate(lead, axis=1)
        gap[:, 1:] = top[:, :-1] - ramp[1:] + np.int32(OPEN - EXTEND)
        opened[:, 1:] = lead[:, :-1] == top[:, :-1]
        left = gap > new
        h = np.maximum(new, gap)
        way = np.where(left, LEFT, DIAGONAL + up).astype(np.int8)
        way[h <= 0] = STOP
        marks[row] = way + grew * np.int8(GREW) + opened * np.int8(OPENED) + up * np.int8(BARE_UP)
        np.maximum(h, 0, out=h)
        col = h.argmax(1)
        got = h[at, col]
        better = got > best
        best[better] = got[better]
        end[better, 0], end[better, 1] = row + 1, col[better]
    return best, end, marks


def _trace(passage: np.ndarray, text: np.ndarray, marks: list, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in passage and text of the words matched by the alignment that ends
    in (i, j); ``marks``: one row of bytes for each word of the passage."""
    out = []
    inside = False  # a gap whose start in the same row is no further gap
    while i and j:
        m = marks[i - 1][j]
        way = m & 3
        if inside and way:
            way = UP if m & BARE_UP else DIAGONAL
        inside = False
        if way == STOP:
            break
        if way == LEFT:
            while not marks[i - 1][j] & OPENED:
                j -= 1
            j, inside = j - 1, True
        elif way == UP:
            while not marks[i - 1][j] & GREW:
                i -= 1
            i -= 1
        else:
            if passage[i - 1] == text[j - 1]:
                out.append((i - 1, j - 1))
            i, j = i - 1, j - 1
    at = np.array(out[::-1], np.int64).reshape(-1, 2)
    return at[:, 0], at[:, 1]


def align(passage: np.ndarray, text: np.ndarray) -> tuple[float, int]:
    """Best local alignment: its score and how many words it matches."""
    best, end, marks = _fill([(passage, text)])
    at, _ = _trace(passage, text, [r.tobytes() for r in marks[:, 0]], *end[0].tolist())
    return float(best[0]) / SCALE, len(at)


def edits_allowed(n):
    """Of n words, one in eight, and as many more as chance may bring."""
    return n * EDITS + 1.5 * np.sqrt(n * EDITS * (1 - EDITS))


def covered(at: np.ndarray, place: np.ndarray) -> int:
    """Words of the passage in the longest stretch of matched words between which
    no more than the allowed edits lie. One longer gap of the text, a foreign
    sentence, is free. Up to EDGE edited words count at the ends, where an
    alignment can't see them, if that many edits are left."""
    n = len(at)
    if not n:
        return 0
    skip, over = np.diff(at) - 1, np.diff(place) - 1
    cost = np.maximum(skip, over)
    free = np.where((over - skip >= FOREIGN[0]) & (over - skip <= FOREIGN[1]), cost - skip, 0)
    total = np.r_[0, np.cumsum(cost)]
    best, block = 0, max(1, 1_000_000 // n)
    for a in range(0, n, block):
        if at[-1] - at[a] + 1 + EDGE <= best:
            break
        first = np.arange(a, min(n, a + block))[:, None]
        span = at[None, a:] - at[first] + 1
        saved = np.maximum.accumulate(np.where(np.arange(a, n - 1)[None] >= first, free[None, a:], 0), axis=1)
        edits = total[None, a:] - total[first] - np.concatenate([np.zeros((len(first), 1), np.int64), saved], axis=1)
        inner = np.arange(a, n)[None] >= first
        spare = np.where(inner, np.floor(edits_allowed(np.maximum(span, 0) + EDGE) - edits), -1)
        best = max(best, int(np.where(spare >= 0, span + np.minimum(spare, EDGE), 0).max()))
    return best


def _reach(length: int, share: float) -> int:
    """Words of a text that a stretch of that share of a passage spans at most."""
    held = math.ceil(share * length)
    return held + FOREIGN[1] + math.ceil(edits_allowed(held))


def stretches(at, place, length: int, need: int):
    """Windows of the text that hold ``need`` distinct seeds in about the passage's
    order, as near to one diagonal as edits and gap allow: (first, last) word places."""
    drift = FOREIGN[1] + math.ceil(edits_allowed(length))
    diagonal = np.asarray(place, np.int64) - np.asarray(at, np.int64)
    order = np.argsort(diagonal, kind="stable")
    at, diagonal = np.asarray(at)[order].tolist(), diagonal[order].tolist()
    out: list[list[int]] = []
    held: Counter = Counter()
    a = 0
    for b in range(len(at)):
        held[at[b]] += 1
        while diagonal[b] - diagonal[a] > drift:
            held[at[a]] -= 1
            if not held[at[a]]:
                del held[at[a]]
            a += 1
        if len(held) >= need:
            lo, hi = diagonal[a] - drift, diagonal[b] + length + GRAM + drift
            if out and lo <= out[-1][1]:
                out[-1][1] = hi
            else:
                out.append([lo, hi])
    return out


def least_score(n: int, share: float) -> float:
    """The score under which no stretch of that share can be: all its edits gaps, and the foreign sentence."""
    held = math.ceil(share * n)
    edits = edits_allowed(held)
    return max(0.0, MATCH * (held - edits) + OPEN * (edits + 1) + EXTEND * FOREIGN[1]) * DENSITY


def _windows(frames):
    """``uid, p, lo, hi``: the windows of each candidate, before its words are fetched."""
    for pdf in frames:
        out = []
        for uid, p, n, need, at, place in zip(*[pdf[c].tolist() for c in ("uid", "p", "n", "need", "at", "place")]):
            out += [(uid, p, max(0, lo), hi) for lo, hi in stretches(at, place, n, need)]
        yield pd.DataFrame(out, columns=["uid", "p", "lo", "hi"])


def _judge(share: float):
    """The best alignment in each window (uid, doc, p, pw, t) that covers the share."""

    def run(frames):
        for pdf in frames:
            jobs = sorted(enumerate(zip(pdf["pw"], pdf["t"])), key=lambda j: len(j[1][1]))
            held: list[tuple] = []
            start = 0
            while start < len(jobs):
                # windows of like width together; one of any length still fits
                stop = start + 1
                while stop < len(jobs) and (stop - start + 1) * len(jobs[stop][1][1]) <= CELLS:
                    stop += 1
                own = jobs[start:stop]
                start = stop
                if not len(own[-1][1][1]):
                    continue
                score, end, marks = _fill([j for _, j in own])
                for n, (row, (p, t)) in enumerate(own):
                    if score[n] >= least_score(len(p), share):
                        i, j = end[n].tolist()
                        lines = [r.tobytes() for r in marks[:i, n]]
                        words_held = covered(*_trace(p, t, lines, i, j))
                        if words_held >= share * len(p):
                            held.append((pdf["uid"].iloc[row], pdf["doc"].iloc[row], pdf["p"].iloc[row], float(score[n]) / SCALE, words_held / len(p)))
                del marks
            yield pd.DataFrame(held, columns=["uid", "doc", "p", "score", "held"])

    return run


def leaked(docs: DataFrame, items: DataFrame, id: str, text: str, item: str, passage: str, share: float, most_bits: int = MOST_BITS) -> DataFrame:
    """``doc, item, score, held``: documents and the test items they repeat,
    with the best alignment's score and the share of the passage's words that
    it covers, which must reach ``share``: matched words and between them about
    one in eight changed, one foreign sentence not counted. The score must only
    reach that of a likeness which is no chance. One row per document row and item.

    ``most_bits``, a power of two, bounds the bitmap that is sent to all tasks; the
    result does not depend on it.

    Null and empty texts and passages match nothing; passages of fewer than
    SEEDS + GRAM - 1 words are too short to be told apart and match nothing.
    Copies of a text or a passage count each. Rows without id are left out.
    Empty input: no rows.
    """
    spark = docs.sparkSession
    schema = "doc bigint, item bigint, score double, held double"
    rows = docs.select(F.col(id).cast("bigint").alias("doc"), F.col(text).alias("t")).filter("doc is not null and t is not null")
    tests = items.select(F.col(item).cast("bigint").alias("i"), F.col(passage).alias("p")).filter("i is not null and p is not null")
    known = materialize(_passages(tests))
    passages = known.groupBy("p").agg(F.first("w").alias("w"), F.first("g").alias("g"))
    seeds = materialize(seeds_of(passages.select("p", "g"), share))
    n, need, longest = seeds.agg(F.count(F.lit(1)), F.min("need"), F.max("n")).first()
    if not n:
        return spark.createDataFrame([], schema)
    bits = min(most_bits, 2 ** max(10, math.ceil(math.log2(BITS_A_SEED * n))))
    table = spark.sparkContext.broadcast(_bitmap(seeds, bits))
    sifted = materialize(
        rows.mapInArrow(_sift(table, bits, need, _reach(longest, share)), "uid bigint, doc bigint, w array<int>, place array<int>, g array<bigint>")
    )
    # shuffled or broadcast as the measured sizes ask for
    hits = sifted.select("uid", F.explode(F.arrays_zip("place", "g")).alias("h")).select("uid", "h.place", "h.g")
    met = (
        hits.join(seeds.select("g", "p", "at", "need", "n"), "g").groupBy("uid", "p")
        .agg(F.first("need").alias("need"), F.first("n").alias("n"), F.collect_list(F.struct("at", "place")).alias("h"))  # bounded by one text
        .filter(F.size(F.array_distinct("h.at")) >= F.col("need"))
        .select("uid", "p", "n", "need", "h.at", "h.place")
    )
    windows = met.mapInPandas(_windows, "uid bigint, p bigint, lo int, hi int")
    full = windows.join(passages.select("p", F.col("w").alias("pw")), "p").join(sifted.select("uid", "doc", "w"), "uid")
    part = F.slice("w", F.col("lo") + 1, F.greatest(F.least("hi", F.size("w")) - F.col("lo"), F.lit(0)))
    aligned = full.select("uid", "doc", "p", "pw", part.alias("t")).mapInPandas(_judge(share), "uid bigint, doc bigint, p bigint, score double, held double")
    best = F.max(F.struct("held", "score"))  # a text may have several windows
    found = aligned.groupBy("uid", "p").agg(F.first("doc").alias("doc"), best.alias("b")).select("p", "doc", "b.score", "b.held")
    return found.join(known.select("p", "item"), "p").select("doc", "item", "score", "held")
