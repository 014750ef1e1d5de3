"""Packing texts into containers of fixed capacity.

Texts are measured in tokens of a public tokenizer and dealt by hash into shards
of bounded size; every shard and container kind is one independent task, so the
work grows in proportion to the rows and no task ever sees more than a shard.
Within a shard, the histogram of lengths is covered by non-negative least
squares: columns are shallow length combinations whose sum falls into a narrow
window under the capacity, the unknowns are how often to repeat each. Rounded
down, they fill most containers to the brim, as each container's last item is the
best of its exact length; what is left over is packed greedily, largest first, into
the tightest gap. The result never needs more containers than that greedy way alone.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.runtime import materialize, parts_for

SHARD_ROWS = 25_000  # items of one shard, on average
CLASSES = 96  # length classes of a histogram
WINDOW = 0.02  # share of the capacity a combination may leave unused
RESERVE = 0.9  # share of a combination's repeats that is used; the rest's items fill the gaps
MAX_KINDS = 1_000

_tokenizers: dict[str, object] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def tokenizer(path: str):
    """The byte-level BPE of a ``.tiktoken`` rank file, once per worker."""
    if path not in _tokenizers:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _tokenizers[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _tokenizers[path]


def token_counts(df: DataFrame, id: str, text: str, vocabulary: str | None = None) -> DataFrame:
    """``id, tokens`` of every row with a text; whole texts are measured."""
    path = vocabulary or default_vocabulary()

    def count(frames):
        encode = tokenizer(path).encode_ordinary
        for pdf in frames:
            yield pd.DataFrame({"id": pdf["id"], "tokens": np.array([len(encode(t)) for t in pdf["t"]], np.int64)})

    rows = df.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("t")).filter("t is not null")
    return rows.mapInPandas(count, "id bigint, tokens bigint")


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares by an active set."""
    m, n = a.shape
    x, free = np.zeros(n), np.zeros(n, bool)
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[free] = -np.inf
        if free.sum() >= m:
            break
        k = int(np.argmax(slope))
        if slope[k] <= 1e-7 * (1 + abs(b).max()):
            break
        free[k] = True
        while True:
            at = np.flatnonzero(free)
            s = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[at] = s
                break
            low = s <= 0
            old = x[at]
            gap = old[low] - s[low]
            step = np.min(np.where(gap > 0, old[low] / np.where(gap > 0, gap, 1), 0.0))
            x[at] = old + step * (s - old)
            drop = at[(x[at] <= 1e-10) & low]
            x[drop] = 0
            free[drop] = False
            if not len(drop):
                break
    return x


def combinations(tops: np.ndarray, capacity: int) -> list[dict[int, int]]:
    """Combinations of at most three length classes, with repeats, that fill
    the window under ``capacity``; ``tops``: each class's greatest length."""
    found: dict[tuple, dict[int, int]] = {}
    least = capacity * (1 - WINDOW)
    n = len(tops)
    second = np.unique(np.linspace(0, n - 1, min(n, 16)).astype(int))
    for i in range(n):
        most = int(capacity // tops[i])
        for times in {1, 2, 3, most // 2, most}:
            if not 1 <= times <= most:
                continue
            rest = capacity - times * int(tops[i])
            tries = [(None, 0)]
            for j in second:
                fit = int(rest // tops[j])
                tries += [(int(j), t) for t in {1, fit // 2, fit} if t >= 1 and t <= fit]
            for j, t in tries:
                left = rest - (t * int(tops[j]) if j is not None else 0)
                k = int(np.searchsorted(tops, left, side="right")) - 1
                combo: dict[int, int] = {i: times}
                if j is not None:
                    combo[j] = combo.get(j, 0) + t
                if k >= 0:
                    more = max(1, int(left // tops[k]))
                    combo[k] = combo.get(k, 0) + more
                total = sum(c * int(tops[q]) for q, c in combo.items())
                if least <= total <= capacity:
                    found.setdefault(tuple(sorted(combo.items())), combo)
    return list(found.values())


def _greedy(lengths: np.ndarray, capacity: int, box: np.ndarray, used: list[int]) -> None:
    """Items without a container, largest first, into the tightest gap."""
    gaps = sorted((capacity - u, b) for b, u in enumerate(used) if u < capacity)
    left = np.flatnonzero(box < 0)
    for item in left[np.lexsort((left, -lengths[left]))].tolist():
        size = int(lengths[item])
        at = bisect_left(gaps, (size, -1))
        if at < len(gaps):
            gap, b = gaps.pop(at)
        else:
            gap, b = capacity, len(used)
            used.append(0)
        used[b] += size
        box[item] = b
        if gap > size:
            insort(gaps, (gap - size, b))


class _Supply:
    """Items by exact length; the longest of at most a given length comes first."""

    def __init__(self, lengths: np.ndarray):
        order = np.lexsort((np.arange(len(lengths)), lengths))
        self.size, starts = np.unique(lengths[order], return_index=True)
        self.items = [order[a:b].tolist() for a, b in zip(starts, [*starts[1:], len(order)])]
        self.below = list(range(len(self.size)))  # the next length with items, at or under each one

    def _find(self, k: int) -> int:
        way = []
        while k >= 0 and not self.items[k]:
            way.append(k)
            self.below[k] = self.below[k] if self.below[k] < k else k - 1
            k = self.below[k]
        for w in way:
            self.below[w] = k
        return k

    def take(self, most: int, least: int = 0) -> int | None:
        """An item of the greatest length within (least, most]."""
        k = self._find(int(np.searchsorted(self.size, most, side="right")) - 1)
        return self.items[k].pop() if k >= 0 and self.size[k] > least else None


def _solved(lengths: np.ndarray, capacity: int, box: np.ndarray, used: list[int]) -> None:
    """Containers of the combinations that least squares repeats. All items of a
    combination but its shortest come from their length classes; the last place
    goes to the item that fills the container best, if it is not far from full."""
    distinct = np.unique(lengths)
    if len(distinct) > CLASSES:
        # equal numbers of items in half of the classes, equal ratios of lengths in the other half
        even = np.quantile(lengths, np.linspace(0, 1, CLASSES // 2 + 1)[1:], method="higher")
        steps = np.geomspace(distinct[0], distinct[-1], CLASSES // 2)
        tops = np.unique(np.concatenate([even, distinct[np.minimum(np.searchsorted(distinct, steps), len(distinct) - 1)]])).astype(np.int64)
    else:
        tops = distinct.astype(np.int64)
    floors = np.r_[0, tops[:-1]]
    hist = np.bincount(np.searchsorted(tops, lengths), minlength=len(tops)).astype(float)
    combos = combinations(tops, capacity)
    if not combos:
        return
    a = np.zeros((len(tops), len(combos)))
    for c, combo in enumerate(combos):
        for q, t in combo.items():
            a[q, c] = t
    scale = 1 / np.sqrt(np.maximum(hist, 1))  # a miss counts relative to the class
    repeat = np.floor(RESERVE * nnls(a * scale[:, None], hist * scale) + 1e-6).astype(int)
    supply = _Supply(lengths)
    for c in np.argsort(-repeat, kind="stable"):
        parts = [q for q in sorted(combos[c], reverse=True) for _ in range(combos[c][q])]
        for _ in range(repeat[c]):
            own: list[int] = []
            total = 0
            for q in parts[:-1]:
                item = supply.take(min(int(tops[q]), capacity - total), int(floors[q]))
                if item is None:
                    break
                own.append(item)
                total += int(lengths[item])
            last = supply.take(capacity - total) if len(own) == len(parts) - 1 else None
            if last is not None:
                own.append(last)
                total += int(lengths[last])
            if last is None or total < capacity * (1 - WINDOW):  # not as planned: back to the supply
                for item in own:
                    k = int(np.searchsorted(supply.size, lengths[item]))
                    supply.items[k].append(item)
                    supply.below[k:] = list(range(k, len(supply.size)))
                break
            box[own] = len(used)
            used.append(total)


def pack(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item; every length is in 1..capacity. The solved
    combinations are kept only where the rest, packed greedily, needs no more
    containers with them than all items packed greedily without them."""
    lengths = np.asarray(lengths, np.int64)
    best, n = np.full(len(lengths), -1, np.int64), None
    for solve in (True, False):
        box, used = np.full(len(lengths), -1, np.int64), []
        if solve and len(lengths):
            _solved(lengths, capacity, box, used)
        _greedy(lengths, capacity, box, used)
        if n is None or len(used) < n:
            best, n = box, len(used)
        if n == -(-int(lengths.sum()) // capacity):
            break  # no packing has fewer
    return best


def pack_texts(
    df: DataFrame, containers: DataFrame, id: str = "doc_id", text: str = "text",
    kind: str = "container_kind", capacity: str = "capacity_tokens", vocabulary: str | None = None,
) -> DataFrame:
    """``container_kind, capacity, container_id, id, piece, start_token, tokens``.

    Every text comes out once per container kind, whole (piece 0) unless it
    exceeds the capacity; then in pieces of exactly the capacity and a rest.
    Null texts are left out; a text without tokens shares the first container
    of its shard. Repeated rows count each. The container table is settings
    (at most MAX_KINDS rows, else an error); capacities must be positive.
    ``container_id`` is unique within a kind. Empty input: no rows.
    """
    kinds = [(r[0], int(r[1])) for r in containers.select(kind, capacity).limit(MAX_KINDS + 1).collect()]
    if len(kinds) > MAX_KINDS or any(c <= 0 for _, c in kinds):
        raise ValueError("container kinds are few and of positive capacity")
    spark = df.sparkSession
    sizes = materialize(token_counts(df, id, text, vocabulary))
    shards = parts_for(sizes.count(), SHARD_ROWS)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(c).cast("bigint").alias("capacity")) for k, c in kinds]))
    dealt = sizes.select("id", "tokens", F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"), each.alias("k")).select(
        "id", "tokens", "shard", "k.kind", "k.capacity"
    )

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "tokens"], kind="stable")
        cap, shard = int(pdf["capacity"].iloc[0]), int(pdf["shard"].iloc[0])
        tokens = pdf["tokens"].to_numpy()
        pieces = np.maximum(1, -(-tokens // cap))
        row = np.repeat(np.arange(len(tokens)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(cap, tokens[row] - piece * cap)
        box = np.zeros(len(row), np.int64)
        real = size > 0
        box[real] = pack(size[real], cap)
        return pd.DataFrame({
            "container_kind": pdf["kind"].iloc[0], "capacity": cap, "container_id": shard * 10**9 + box,
            "id": pdf["id"].to_numpy()[row], "piece": piece, "start_token": piece * cap, "tokens": size,
        })

    schema = "container_kind string, capacity bigint, container_id bigint, id bigint, piece bigint, start_token bigint, tokens bigint"
    if not kinds:
        return spark.createDataFrame([], schema)
    return dealt.groupBy("kind", "shard").applyInPandas(fill, schema)
