"""The llm operators against brute force, round trips and edge cases."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import clusters
from sluice.llm.clusters import assigned, describe_groups, exact_groups_by_force, fit_mixture, mixture_clusters, similarity_groups, unit_vectors
from sluice.llm.leaks import EXTEND, MATCH, MISS, OPEN, SCALE, _fill, align, covered, edits_allowed, FOREIGN, EDGE, grams, leaked, numbers, words
from sluice.llm.packing import pack, pack_texts, tokenizer, default_vocabulary
from sluice.llm.percentiles import percentiles, summarize
from sluice.llm.spam import describe, stuffed
from sluice.llm.topn import top_n


# --- percentiles --------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["bigint", "double"])
def test_percentiles_are_exact(spark, kind):
    rng = random.Random(1)
    make = (lambda: rng.choice([rng.randrange(-(2**31), 2**31), rng.randrange(10), 7])) if kind == "bigint" else (lambda: rng.choice([rng.gauss(0, 1e9), rng.random(), -0.5, 1e-300]))
    rows = [("hot" if rng.random() < 0.4 else f"g{rng.randrange(5)}", rng.randrange(3), make(), "x", 1, 2) for _ in range(4000)]
    rows += [("one", 0, make(), "x", 1, 2), ("null", 0, None, "x", 1, 2), (None, 0, make(), "x", 1, 2)]
    df = spark.createDataFrame(rows, f"g string, day int, v {kind}, lo string, hi int, w int").repartition(5)
    by = defaultdict(list)
    for g, _, v, *_ in rows:
        if g is not None and v is not None:
            by[g].append(v)
    want = {g: (len(v), *[sorted(v)[-(-len(v) * p // 100) - 1] for p in (50, 90, 95, 99)]) for g, v in by.items()}
    assert {r[0]: tuple(r)[1:] for r in percentiles(df, ["g"], "v").collect()} == want
    days = summarize(df, ["g", "day"], "v")
    assert {r[0]: tuple(r)[1:] for r in percentiles(days, ["g"], "value", weight="n").collect()} == want
    undated = summarize(df.withColumn("day", F.when(F.col("day") > 0, F.col("day"))), ["g", "day"], "v")
    assert {r[0]: tuple(r)[1:] for r in percentiles(undated, ["g"], "value", weight="n").collect()} == want
    near = {r[0]: r for r in percentiles(df, ["g"], "v", tolerance=1000).collect()}
    assert all(0 <= near[g].p90 - want[g][2] <= 1000 for g in want)
    assert percentiles(df.limit(0), ["g"], "v").count() == 0


def test_percentiles_of_extreme_values(spark):
    big = [2**63 - 1, -(2**63), 0, 1, -1]
    df = spark.createDataFrame([("a", v) for v in big], "g string, v bigint")
    assert tuple(percentiles(df, ["g"], "v").first()) == ("a", 5, 0, 2**63 - 1, 2**63 - 1, 2**63 - 1)
    nan = spark.createDataFrame([("a", float("nan")), ("a", 2.0)], "g string, v double")
    assert percentiles(nan, ["g"], "v").first().n == 1


# --- top n --------------------------------------------------------------------------------


def test_top_n_ties_nulls_and_hot_groups(spark):
    rng = random.Random(2)
    rows = [(i, None if rng.random() < 0.05 else "hot" if rng.random() < 0.4 else f"g{rng.randrange(40)}", None if rng.random() < 0.1 else rng.randrange(6), "c") for i in range(5000)]
    rows += rows[:300]
    df = spark.createDataFrame(rows, "id bigint, region string, rev int, grp string").repartition(7)
    by = defaultdict(list)
    for i, g, v, _ in rows:
        if g is not None and v is not None:
            by[g].append((-v, i))
    want = sorted((g, i) for g, v in by.items() for _, i in sorted(v)[:5])
    assert sorted((r.grp, r.id) for r in top_n(df, "region", "rev", "id", 5).collect()) == want
    assert top_n(df.limit(0), "region", "rev", "id").count() == 0


def test_top_n_of_a_large_task(spark):
    """More rows than a task holds at once, with few and with very many groups."""
    for groups in (3, 450_000):
        df = spark.range(900_000).coalesce(1).select("id", (F.col("id") % groups).cast("string").alias("g"), (F.col("id") % 7).alias("v"))
        got = top_n(df, "g", "v", "id", 2)
        assert tuple(got.agg(F.count(F.lit(1)), F.countDistinct("grp")).first()) == (2 * groups, groups)
    few = top_n(spark.range(900_000).coalesce(1).select("id", F.lit("a").alias("g"), (F.col("id") % 7).alias("v")), "g", "v", "id", 2)
    assert sorted(r.id for r in few.collect()) == [6, 13]


# --- groups -------------------------------------------------------------------------------


def vectors(rng, groups, noise, dim=12):
    out = []
    for size in groups:
        c = rng.normal(size=dim)
        out += [c / np.linalg.norm(c) * rng.uniform(0.5, 3) + noise * rng.normal(size=dim) for _ in range(size)]
    return out


@pytest.mark.parametrize("noise, chunk", [(0.05, 1500), (0.12, 12)])
def test_groups_match_brute_force(spark, noise, chunk):
    """Tight groups, overlapping ones that are no cliques, and one that holds a
    third of the rows, with ordinary and with tiny chunks."""
    rng = np.random.default_rng(4)
    v = vectors(rng, [60, 20, 10, 5, 3, 2, 2] + [1] * 40, noise)
    bad = [None, [], [0.0] * 12, [float("nan")] + [1.0] * 11, [None] + [1.0] * 11, [float("inf")] * 12, [1.0] * 5]
    rows = [(i, [float(y) for y in x], 1.0) for i, x in enumerate(v)] + [(1000 + i, b, 1.0) for i, b in enumerate(bad)]
    df = spark.createDataFrame(rows, "item bigint, e array<double>, u double").repartition(3)
    units = unit_vectors(df, "item", "e")
    got = {(r.id, r.head) for r in similarity_groups(units, chunk=chunk).collect()}
    ids, u = zip(*[(r.id, r.u) for r in units.collect()])
    assert got == exact_groups_by_force(np.array(ids), np.array(u, float), 0.86)
    assert all(i < 1000 for i, _ in got)


def test_groups_edges_and_description(spark):
    empty = spark.createDataFrame([], "item bigint, e array<double>")
    assert similarity_groups(unit_vectors(empty, "item", "e")).count() == 0
    one = spark.createDataFrame([(1, [1.0, 0.0])], "item bigint, e array<double>")
    assert similarity_groups(unit_vectors(one, "item", "e")).count() == 0
    same = spark.createDataFrame([(i, [1e-200, 2e-200]) for i in range(5)] + [(9, [1.0, -1.0])], "item bigint, e array<double>")
    members = similarity_groups(unit_vectors(same, "item", "e"))
    assert {(r.id, r.head) for r in members.collect()} == {(i, 0) for i in range(5)}
    d = describe_groups(members).first()
    assert (d["head"], d["size"], len(d["typical"])) == (0, 5, 3)


def test_groups_of_balls_that_leave_a_doubt(spark):
    """Groups in many balls, and lone rows that are alike to some of their members only."""
    rng = np.random.default_rng(6)
    axis = np.eye(10)
    v, limit = [], np.arccos(0.86)
    turn = lambda a, b, t: np.cos(t) * a + np.sin(t) * b
    for k in range(4):
        size = 0.24 if k < 2 else 0.1
        v += [turn(axis[2 * k], axis[2 * k + 1], rng.uniform(-size, size)) for _ in range(90)]
        if k % 2:
            v.append(turn(axis[2 * k], axis[2 * k + 1], limit + size / 2))  # spoils the group
        else:
            v.append(turn(axis[2 * k], axis[2 * k + 1], limit + size + 0.02))  # just outside
    df = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)], "item bigint, e array<double>").repartition(3)
    units = unit_vectors(df, "item", "e")
    ids, u = zip(*[(r.id, r.u) for r in units.collect()])
    want = exact_groups_by_force(np.array(ids), np.array(u, float), 0.86)
    assert len(want) == 180
    for chunk in (6, 25, 1500):
        assert {(r.id, r.head) for r in similarity_groups(units, chunk=chunk).collect()} == want


def test_a_large_cloud_of_chains_has_no_groups(spark):
    """200,000 rows along a closed curve, each alike to its neighbours only, and one group aside."""
    t = F.col("id") * (2 * np.pi / 200_000)
    curve = [f(t * k) for k in (1, 2, 3) for f in (F.cos, F.sin)]
    cloud = spark.range(200_000).select("id", F.array(*curve, F.lit(0.0)).alias("e"))
    aside = spark.range(200_000, 200_030).select("id", F.array(*[F.lit(0.01) * (F.col("id") % 3)] * 6, F.lit(1.0)).alias("e"))
    got = similarity_groups(unit_vectors(cloud.unionByName(aside), "id", "e")).collect()
    assert {(r.id, r.head) for r in got} == {(i, 200_000) for i in range(200_000, 200_030)}


def test_mixture_clusters(spark):
    rng = np.random.default_rng(2)
    v = vectors(rng, [200, 100, 50], 0.03)
    df = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)], "item bigint, e array<double>")
    units = unit_vectors(df, "item", "e")
    fitted = fit_mixture(units.cache())
    rows = mixture_clusters(units, 5, fitted).collect()
    assert sum(r["size"] for r in rows) == 350 and len({r.cluster for r in rows}) == len(rows) == len(fitted.model.weight)
    assert fitted.scores[min(fitted.scores, key=fitted.scores.get)] < fitted.scores[max(fitted.scores)]  # the criterion turned
    for r in rows:
        home = {0 if i < 200 else 1 if i < 300 else 2 for i in r.typical}
        assert len(r.typical) == min(5, r["size"]) and len(home) == 1
    assert mixture_clusters(units.limit(0)).count() == 0


def test_mixture_prefers_the_true_number_of_components(spark):
    rng = np.random.default_rng(0)
    v = vectors(rng, [150] * 4, 0.05)
    units = unit_vectors(spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)], "item bigint, e array<double>"), "item", "e").cache()
    f = fit_mixture(units, counts=(1, 4))
    assert f.scores[4] < f.scores[1] and len(f.model.weight) == 4


def test_mixtures_are_fitted_to_all_rows(spark, monkeypatch):
    """20,000 rows of one kind and 200 of another whose hashes are among the greatest, so
    that no choice of rows by hash, id and all, that leaves a quarter out, holds them."""
    part = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1_000_000))
    rare = [r.id for r in spark.range(20_000, 22_000).filter(part > 750_000).limit(200).collect()]
    rng = np.random.default_rng(3)
    v = np.vstack([np.eye(5)[0] + 0.1 * rng.normal(size=(20_000, 5)), np.eye(5)[1] + 0.1 * rng.normal(size=(200, 5))])
    rows = [(i, [float(y) for y in x]) for i, x in zip([*range(20_000), *rare], v)]
    units = unit_vectors(spark.createDataFrame(rows, "item bigint, e array<double>"), "item", "e").cache()
    u = np.array([r.u for r in units.collect()], float)

    f = fit_mixture(units, counts=(1,))
    likelihood = np.logaddexp.reduce(f.logs(u), axis=1).sum()
    assert f.scores[1] == pytest.approx(f.model.free_parameters() * np.log(20_200) - 2 * likelihood, rel=1e-9)

    f = fit_mixture(units)
    homes = {(r.comp, r.id >= 20_000) for r in assigned(units, f).select("comp", "id").collect()}
    assert len(f.model.weight) > 1 and len(homes) == len({comp for comp, _ in homes})  # none holds both kinds

    z = f.reduce(u)
    whole = clusters._statistics(f.model, z)
    monkeypatch.setattr(clusters, "CELLS", 1_000)
    assert clusters._statistics(f.model, z) == pytest.approx(whole, rel=1e-9, abs=1e-6)
    monkeypatch.setattr(clusters, "_PARTS", 2)  # fewer than cores: partial sums are added in groups first
    assert fit_mixture(units, counts=(1, 2)).scores == pytest.approx({k: f.scores[k] for k in (1, 2)}, rel=1e-9)


# --- packing ------------------------------------------------------------------------------


@pytest.mark.parametrize("capacity", [1, 7, 100, 1000])
def test_pack_never_overfills(capacity):
    rng = np.random.default_rng(capacity)
    sizes = np.minimum(capacity, rng.lognormal(2, 1, 3000).astype(int) + 1)
    box = pack(sizes, capacity)
    fill = np.bincount(box, weights=sizes)
    assert fill.max() <= capacity and (box >= 0).all() and (fill > 0).all()
    if capacity >= 100:
        assert sizes.sum() / (len(fill) * capacity) > 0.95


@pytest.mark.parametrize("capacity", [64, 512, 4096])
def test_packing_is_never_worse_than_greedy(capacity):
    from sluice.llm.packing import _greedy, _solved

    rng = np.random.default_rng(capacity)
    for sizes in (rng.lognormal(4, 1, 4000), rng.uniform(0.3, 0.6, 3000) * capacity, np.full(500, 0.35 * capacity), rng.choice([0.2, 0.45, 0.55], 2000) * capacity):
        sizes = np.clip(sizes.astype(int), 1, capacity)
        box, used = np.full(len(sizes), -1), []
        _greedy(sizes, capacity, box, used)
        fill = np.bincount(pack(sizes, capacity), weights=sizes)
        assert len(fill) <= len(used) and fill.max() <= capacity and (fill > 0).all()
    sizes = np.clip(rng.lognormal(4, 1, 4000).astype(int), 1, 512)
    box, used = np.full(len(sizes), -1), []
    _solved(sizes, 512, box, used)
    assert len(used) * 512 > 0.5 * sizes.sum() and sum(used) > 0.999 * 512 * len(used)  # the combinations carry the packing


def test_pack_texts_round_trip(spark):
    texts = ["", "a", None, "word " * 700, "één twee drie", "x" * 30_000, "same text", "same text", "日本語" * 500]
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in enumerate(texts)], "doc_id bigint, text string, tokens int, kind string")
    kinds = spark.createDataFrame([("s", 16), ("l", 512)], "container_kind string, capacity_tokens int")
    rows = pack_texts(df, kinds).collect()
    encode = tokenizer(default_vocabulary()).encode_ordinary
    for kind, cap in (("s", 16), ("l", 512)):
        mine = [r for r in rows if r.container_kind == kind]
        use = defaultdict(int)
        for r in mine:
            use[r.container_id] += r.tokens
        assert max(use.values()) <= cap
        for i, t in enumerate(texts):
            parts = sorted((r.piece, r.start_token, r.tokens) for r in mine if r.id == i)
            if t is None:
                assert not parts
                continue
            n = len(encode(t))
            assert sum(p[2] for p in parts) == n and [p[0] for p in parts] == list(range(len(parts)))
            assert len(parts) == max(1, -(-n // cap)) and all(p[1] == p[0] * cap for p in parts)
    assert pack_texts(df.limit(0), kinds).count() == 0
    with pytest.raises(ValueError):
        pack_texts(df, spark.createDataFrame([("z", 0)], "container_kind string, capacity_tokens int"))


# --- leaks --------------------------------------------------------------------------------


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


VOCABULARY = [f"w{i}{c}" for i in range(300) for c in "ab"]


def edit(rng, text):
    """One word in eight left out, misspelt or followed by another."""
    out = []
    for k, w in enumerate(text.split()):
        kind = rng.randrange(3) if k % 8 == 5 else None
        if kind != 0:
            out.append(w[::-1] + "q" if kind == 1 else w)
        if kind == 2:
            out.append(rng.choice(VOCABULARY))
    return " ".join(out)


def test_leaks_found_edited_partial_and_interrupted(spark):
    rng = random.Random(9)
    items = [(i, prose(rng, 100)) for i in range(30)]
    docs, want = [], set()
    for i, p in items[:20]:
        w = p.split()
        part = " ".join(w[20:70]) if i % 3 == 0 else p
        body = edit(rng, part)
        if i % 4 == 1:
            cut = len(body) // 2
            body = body[:cut] + " <b>" + prose(rng, 15) + "</b> " + body[cut:]
        body = f"{prose(rng, 40)}\n<p>{body.upper() if i % 2 else body.replace(' ', '  ' + chr(0x200B))}&nbsp;</p>{prose(rng, 40)}"
        docs += [(i, body)] * (3 if i == 5 else 1)
        want.add((i, i))
    for i, p in items[20:]:
        docs.append((i, prose(rng, 30) + " " + " ".join(p.split()[:20]) + " " + prose(rng, 200)))  # a quote only
    docs += [(100, None), (101, ""), (102, "x" * 100_000), (103, prose(rng, 20_000) + " " + items[0][1]), (None, items[0][1])]
    want.add((103, 0))
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id bigint, text string, doc int, item int").repartition(3)
    e = spark.createDataFrame([*items, (900, None), (901, ""), (902, "too short")], "eval_id bigint, passage string")
    got = [(r.doc, r.item) for r in leaked(d, e, "doc_id", "text", "eval_id", "passage", 0.4).collect()]
    assert set(got) == want and got.count((5, 5)) == 3
    full = [(r.doc, r.item) for r in leaked(d, e, "doc_id", "text", "eval_id", "passage", 0.4, most_bits=1024).collect()]
    assert sorted(full) == sorted(got)  # a bitmap that is full decides nothing
    assert leaked(d.limit(0), e, "doc_id", "text", "eval_id", "passage", 0.4).count() == 0
    assert leaked(d, e.limit(0), "doc_id", "text", "eval_id", "passage", 0.4).count() == 0


def test_leaks_are_decided_by_the_covered_share(spark):
    """Quotes of 45 % with words dropped or replaced and a foreign sentence are
    found; exact quotes of a third are not."""
    rng = random.Random(11)
    items = [(i, prose(rng, 100)) for i in range(24)]
    docs = []
    for i, p in items:
        w = p.split()
        if i < 16:
            part = [x if k % 8 != 5 else "other" for k, x in enumerate(w[30:75]) if k % 8 != 5 or i % 2]
            if i % 4 < 2:
                part[20:20] = prose(rng, 15).split()
        else:
            part = w[30:63]
        docs.append((i, prose(rng, 30) + " " + " ".join(part) + " " + prose(rng, 30)))
    d, e = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "eval_id bigint, passage string")
    got = [(r.doc, r.item) for r in leaked(d, e, "doc_id", "text", "eval_id", "passage", 0.4).collect()]
    assert sorted(got) == [(i, i) for i in range(16)]


def test_leaks_of_passages_that_many_items_hold(spark):
    """Equal passages, and unlike ones that share most of their text, keep seeds."""
    rng = random.Random(12)
    same, shared = prose(rng, 100), prose(rng, 90)
    items = [(i, same if i % 2 else same.upper() + "!") for i in range(8)] + [(i, f"{prose(rng, 5)} {shared} {prose(rng, 5)}") for i in range(10, 18)] + [(i, prose(rng, 100)) for i in range(20, 30)]
    docs = [(1, f"{prose(rng, 30)} {edit(rng, same)} {prose(rng, 30)}"), (2, f"{prose(rng, 30)} {edit(rng, ' '.join(shared.split()[20:70]))} {prose(rng, 30)}"), (3, prose(rng, 200))]
    d, e = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "eval_id bigint, passage string")
    got = [(r.doc, r.item) for r in leaked(d, e, "doc_id", "text", "eval_id", "passage", 0.4).collect()]
    assert sorted(got) == [(1, i) for i in range(8)] + [(2, i) for i in range(10, 18)]


@pytest.mark.parametrize("copies", [5, 50])
def test_leaks_of_a_passage_that_many_items_repeat(spark, copies):
    rng = random.Random(13)
    p = prose(rng, 80)
    items = [(i, p) for i in range(copies)] + [(1000 + i, prose(rng, 80)) for i in range(5)]
    d, e = spark.createDataFrame([(1, f"{prose(rng, 30)} {p} {prose(rng, 9)}")], "doc_id bigint, text string"), spark.createDataFrame(items, "eval_id bigint, passage string")
    assert sorted(r.item for r in leaked(d, e, "doc_id", "text", "eval_id", "passage", 0.4).collect()) == list(range(copies))


def brute_score(p, t):
    """Smith-Waterman with affine gaps, cell by cell."""
    h = [[0] * (len(t) + 1) for _ in range(len(p) + 1)]
    for i in range(1, len(p) + 1):
        for j in range(1, len(t) + 1):
            up = max(h[i - k][j] + OPEN + EXTEND * (k - 1) for k in range(1, i + 1))
            left = max(h[i][j - k] + OPEN + EXTEND * (k - 1) for k in range(1, j + 1))
            h[i][j] = max(0, up, left, h[i - 1][j - 1] + (MATCH if p[i - 1] == t[j - 1] else MISS))
    return max(map(max, h))


def brute_covered(at, place):
    best = 0
    for a in range(len(at)):
        edits = saved = 0
        for b in range(a, len(at)):
            if b > a:
                skip, over = at[b] - at[b - 1] - 1, place[b] - place[b - 1] - 1
                edits += max(skip, over)
                if FOREIGN[0] <= over - skip <= FOREIGN[1]:
                    saved = max(saved, max(skip, over) - skip)
            span = int(at[b] - at[a] + 1)
            spare = np.floor(edits_allowed(span + EDGE) - edits + saved)
            if spare >= 0:
                best = max(best, span + int(min(spare, EDGE)))
    return best


def test_alignments_side_by_side_agree_with_brute_force():
    rng = np.random.default_rng(5)
    jobs = [(rng.integers(0, 6, rng.integers(1, 25)), rng.integers(0, 6, rng.integers(1, 40))) for _ in range(60)]
    assert _fill(jobs)[0].tolist() == [brute_score(p, t) for p, t in jobs]
    for p, t in jobs:
        assert align(p, t)[0] == brute_score(p, t) / SCALE
    for _ in range(60):
        at, place = (np.cumsum(rng.choice([1, 1, 1, 2, 3, 9], 30)) for _ in range(2))
        assert covered(at, place) == brute_covered(at, place)


def test_alignment_score():
    a = np.arange(20)
    assert align(a, a) == (40.0, 20)
    with_gap = np.r_[a[:10], np.full(15, -1), a[10:]]
    assert align(a, with_gap)[1] == 20
    assert align(a, np.full(9, -1)) == (0.0, 0)


def test_words_ignore_layout():
    assert words("The <i>Cat</i>&amp;dog­ s​at!") == words("the cat dog SAT")
    assert words("日本 語") == ["日", "本", "語"]
    assert len(grams(numbers(words("a b c d")))) == 2 and len(grams(numbers(["a"]))) == 0


# --- spam ---------------------------------------------------------------------------------


def test_spam_separates_lists_from_sentences(spark):
    rng = random.Random(3)
    subjects, objects = ["The lamp", "My sister", "This kettle", "Our neighbour"], ["in the kitchen", "with the old handle", "for the garden", "to the shop"]
    good = [" ".join(f"{rng.choice(subjects)} was {rng.choice(['fine', 'blue', 'loud'])} and stood {rng.choice(objects)} for {rng.randrange(90)} days." for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    nouns = ["lamp", "kettle", "cheap", "sale", "shop", "mattress", "deal", "toaster", "new", "online"]
    bad = [
        ", ".join(rng.choice(nouns) for _ in range(40)), "\n".join(f"https://a{i}.example/{rng.choice(nouns)}" for i in range(20)),
        " ".join(f"#{rng.choice(nouns)}{rng.choice(nouns)}" for _ in range(30)), "Home > " + " > ".join(rng.choice(nouns) for _ in range(30)),
        good[0].split(".")[0] + ". " + " | ".join(rng.choice(nouns) for _ in range(80)), "安い 時計 通販 激安 " * 20, ". ".join(" ".join(rng.choice(nouns) for _ in range(5)) for _ in range(20)),
    ]
    texts = good + bad + [None, "", "ok", good[1] + " https://a.example/x #lamp", "word " * 40_000]
    df = spark.createDataFrame([(i, t, None if i % 7 == 0 else "en", 1.0) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, dense double")
    rows = {r.id: r for r in stuffed(df, "doc_id", "text", "lang").collect()}
    found = {i for i, r in rows.items() if r.flagged and r.dense > 0.5 and r.chars >= 80}
    n = len(good)
    assert found == set(range(n, n + len(bad))) | {len(texts) - 1}
    assert n + len(bad) not in rows and not rows[n + len(bad) + 1].flagged
    assert stuffed(df.limit(0), "doc_id", "text", "lang").count() == 0


def test_stuffed_texts_make_no_norm(spark):
    """As many stuffed texts of unknown language as there may be, alone or with reviews."""
    rng = random.Random(4)
    nouns = ["lamp", "kettle", "cheap", "sale", "shop", "mattress", "deal", "toaster", "new", "online"]
    bad = [(i, ", ".join(rng.choice(nouns) for _ in range(rng.randrange(20, 60))), None) for i in range(80)]
    good = [(1000 + i, " ".join(f"The lamp was {rng.choice(['fine', 'blue', 'loud'])} and stood in the kitchen for {rng.randrange(90)} days." for _ in range(rng.randrange(2, 9))), None) for i in range(160)]
    for rows in (bad + good, bad, bad[:3], [(i, t, "xx") for i, t, _ in bad] + good):
        got = stuffed(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), "doc_id", "text", "lang").filter("flagged and dense > 0.5").collect()
        assert {r.id for r in got} == {i for i, *_ in rows if i < 1000}


def test_density_does_not_depend_on_layout():
    keys = ["air mattress", "sale", "bike pump", "cheap rucksack"] * 6
    for sep in (", ", " | ", "\n", " · ", "; ", "\t", ". ", " - ", "/"):
        assert describe(sep.join(keys))[2][0] == 1.0
    assert describe("I really really really liked it, and the kids did too.")[2][0] == 0.0


def test_search_phrases_with_function_words():
    keys = ["best tea pot for small kitchens", "how to clean a tea pot", "tea pot with lid", "tea pot for two", "tea pot in blue", "what is the best tea pot"] * 2
    for sep in (", ", " | ", "\n", "; ", ". "):
        assert describe(sep.join(keys))[2][0] > 0.9
    assert describe(" ".join(k for k in keys if not k.startswith(("how", "what"))))[2][0] > 0.9
    for text in (
        "The tea pot is fine, and the lid of the tea pot fits. I use the tea pot in the kitchen, my sister has a tea pot too. It was a good tea pot.",
        "I bought it for my sister, for my mother, for my aunt, and for all of us in the house. They were really, really, really happy with it.",
    ):
        assert describe(text)[2][0] == 0.0


FOREIGN_REVIEWS = [
    "Ik heb deze lamp gekocht voor de keuken en hij werkt prima. De kleur is mooi en het licht is warm. Ik zou hem zo weer kopen.",
    "To jest bardzo dobra lampa do kuchni. Kupiłem ją dla siostry i jest zadowolona. Nie mam żadnych zastrzeżeń, polecam każdemu.",
    "Questa lampada funziona bene e mi piace molto. Comprata per la cucina di mia madre, arrivata dopo due giorni. La consiglio a tutti.",
    "这盏灯非常好，我很喜欢。质量也不错，价格便宜，送货也很快。包装完整没有损坏。客服态度热情，有问必答。下次还会再买，推荐给大家。放在卧室里看书非常合适，光线柔和不刺眼，孩子写作业时也愿意使用，家里老人都说好用。",
]


def test_reviews_in_other_languages_are_not_stuffed_but_keywords_are(spark):
    rng = random.Random(5)
    good = [(i, f"The lamp was {rng.choice(['fine', 'blue', 'loud'])} and it stood in the kitchen for {rng.randrange(90)} days. My sister was happy with it.", "en") for i in range(100)]
    foreign = [(1000 + i, t, lang) for i, t in enumerate(FOREIGN_REVIEWS) for lang in (None,)] + [(1100 + i, t, "xx") for i, t in enumerate(FOREIGN_REVIEWS)]
    walls = ["goedkoop matras aanbieding korting lamp bestellen ", "tania lampa promocja sklep rabat wysyłka ", "lampada sconto offerta negozio spedizione gratis ", "便宜台灯 促销 特价 "]
    bad = [(2000 + i, w * 6, None) for i, w in enumerate(walls)] + [(2100 + i, (w.strip().capitalize() + ". ") * 6, None) for i, w in enumerate(walls[:3])]
    df = spark.createDataFrame(good + foreign + bad, "doc_id bigint, text string, lang string")
    assert {r.id for r in stuffed(df, "doc_id", "text", "lang").filter("flagged").collect()} == {i for i, *_ in bad}
    alone = spark.createDataFrame(foreign + bad, "doc_id bigint, text string, lang string")  # no text makes a norm
    assert {r.id for r in stuffed(alone, "doc_id", "text", "lang").filter("flagged").collect()} == {i for i, *_ in bad}


def test_the_distance_decides(spark):
    """The farther, the more keywords; the cut lies where they are about half of the text."""
    sentence = "The lamp was fine and it stood in the kitchen for days. "
    texts = [sentence * 3 + " ".join(["cheap lamp sale shop deal"] * k) for k in range(0, 40, 2)]
    rows = {r.id: r for r in stuffed(spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string"), "doc_id", "text", "lang").collect()}
    flags = [rows[i].flagged for i in range(len(texts))]
    assert flags == sorted(flags) and not flags[0] and flags[-1]
    assert all(r.flagged == (r.distance > 30 and r.towards > 0.3) for r in rows.values())
    assert all(r.flagged == (r.dense > 0.5) for r in rows.values() if not 0.45 < r.dense < 0.55)


def test_plain_texts_are_described_as_by_the_scan():
    from sluice.llm.spam import _scanned, _words_only

    rng = random.Random(6)
    bits = ["the", "and", "lamp", "kettle", "air mattress", "für", "ist", "de", "la", ". ", "! ", "\n", ", ", " | ", " - ", "; ", "?) ", "ß", "42", "x_y", "...", "#tag"]
    for _ in range(400):
        text = " ".join(rng.choice(bits) for _ in range(rng.randrange(1, 120)))
        a, b = _words_only(text), _scanned(text)
        assert (a.sizes, a.dense, a.glue, a.counts) == (b.sizes, b.dense, b.glue, b.counts)
        assert [p for p in a.pieces if p[1]] == [p for p in b.pieces if p[1]]


@pytest.mark.parametrize("text", ["x" * 300_000 + " a/b", "." * 300_000 + "x", " ".join(f"w{i}" for i in range(60_000)), "a-" * 150_000 + "/", "<" * 100_000, "日" * 200_000, "[" * 100_000 + "&lt;" * 30_000])
def test_long_runs_cost_no_more_than_their_length(text):
    import time

    began = time.process_time()
    describe(text)
    words(text)
    assert time.process_time() - began < 10


# --- queries ------------------------------------------------------------------------------


def test_found_queries_have_the_agreed_columns(spark):
    import os

    from sluice.llm.queries import QUERIES

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    for name, cols in {"p6_found": ["region", "sale_id"], "p7_found": ["item_id", "head_id"], "p9_found": ["doc_id", "eval_id"], "p10_found": ["doc_id"]}.items():
        df = QUERIES[name](spark, d)
        assert df.columns == cols and df.count() > 0
    assert QUERIES["p8_fill"](spark, d).filter(F.col("fill") > 1).count() == 0
