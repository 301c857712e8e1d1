"""Exact similarity joins, ordered greedy selection and entity resolution against their sequential forms."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from memlake.operators import cluster, search, similarity, write


def vectors(n, dim=16, centres=12, spread=0.15, seed=1):
    r = np.random.default_rng(seed)
    c = r.normal(size=(centres, dim))
    v = c[r.integers(0, centres, n)] + spread * r.normal(size=(n, dim)) * np.linalg.norm(c[0]) / dim**0.5
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def rows(spark, v, groups):
    return spark.createDataFrame([(k, g, x.tolist()) for k, (g, x) in enumerate(zip(groups, v, strict=True))], "id long, user_id string, embedding array<double>").repartition(4)


def brute(v, groups, threshold):
    s = v @ v.T
    return {(a, b) for a in range(len(v)) for b in range(a + 1, len(v)) if groups[a] == groups[b] and s[a, b] >= threshold}


@pytest.mark.parametrize("threshold", [0.95, 0.8, 0.3])
def test_pairs_by_brute_force(spark, threshold):
    v = vectors(700)
    v[5] = v[6] = v[7]
    groups = [None if k % 3 == 0 else "u" for k in range(len(v))]
    odd = spark.createDataFrame([(9000, "u", None), (9001, "u", []), (9002, "u", [1.0]), (9003, "u", [0.0] * 16)], "id long, user_id string, embedding array<double>")
    got = [(r["a"], r["b"]) for r in similarity.similar_pairs(rows(spark, v, groups).union(odd), threshold, "user_id").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(v, groups, threshold)
    assert search.near_pairs(odd.where("id < 0"), threshold, "user_id").collect() == []


def test_pivots_leave_few_pairs_to_compare(spark):
    """Of the pairs of a group, most are never looked at, and no task has more than two blocks."""
    v = vectors(3000, centres=60, spread=0.05)
    df = rows(spark, v, ["u"] * len(v))
    offered = similarity.compared(df, 0.98, "user_id")
    assert offered < 0.1 * len(v) ** 2 / 2
    assert similarity.similar_pairs(df, 0.98, "user_id").count() == len(brute(v, ["u"] * len(v), 0.98))


def one_by_one(order, edges, least):
    """The sequential rule."""
    near, taken, out = {}, set(), {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for x in order:
        if x not in taken:
            free = [y for y in near.get(x, ()) if y not in taken]
            if len(free) + 1 >= least:
                for y in [x, *free]:
                    out[y] = x
                    taken.add(y)
    return out


@pytest.mark.parametrize("least", [1, 2, 3])
@pytest.mark.parametrize("degree", [1, 4])
def test_greedy_in_rounds_is_the_sequence(spark, least, degree):
    r = random.Random(least * 10 + degree)
    n = 150
    order = r.sample(range(n), n)
    edges = [(a, b) for a in range(n) for b in range(a) if r.random() < degree / n]
    nodes = spark.createDataFrame([(x, k) for k, x in enumerate(order)], "id long, ord long")
    got = similarity.greedy(nodes, spark.createDataFrame([*edges, (3, 3)], "a long, b long"), least).collect()
    assert len(got) == len({x["id"] for x in got})
    assert {x["id"]: x["centre"] for x in got} == one_by_one(order, edges, least)


def test_affinity_clusters_are_the_sequence(spark):
    r = random.Random(4)
    v = vectors(160, centres=8)
    hours = [r.random() * 6 for _ in v]
    users = ["hot" if k % 3 else f"u{k % 4}" for k in range(len(v))]
    weight = [r.choice([None, 0.2, 0.5, 0.9]) for _ in v]
    data = [(k, users[k], weight[k], hours[k], x.tolist()) for k, x in enumerate(v)]
    df = spark.createDataFrame(data, "id long, user_id string, importance double, hours double, embedding array<double>")
    df = df.withColumn("created_at", F.timestamp_micros((F.col("hours") * 3.6e9).cast("long")))
    got = cluster.affinity_clusters(df, "user_id", threshold=0.8).collect()
    a = 0.5 * (v @ v.T) + 0.5 * np.exp(-0.1 * np.abs(np.subtract.outer(hours, hours)))
    edges = [(i, j) for i in range(len(v)) for j in range(i) if users[i] == users[j] and a[i, j] >= 0.8]
    want = one_by_one(sorted(range(len(v)), key=lambda k: (-(weight[k] or 0), k)), edges, 3)
    assert {x["id"]: x["cluster"] for x in got} == want and len(want) > 40
    for x in got:
        own = [i for i, c in want.items() if c == x["cluster"] and i != c]
        assert x["affinity"] == pytest.approx(np.mean([a[i, x["cluster"]] for i in own]), abs=1e-5) and x["user_id"] == users[x["id"]]


def resolved(mentions, threshold):
    """Mentions one by one."""
    entities, out = [], {}
    for i, _, user, kind, name, aliases, v in sorted(mentions, key=lambda m: m[1]):
        own = [e for e in entities if e["scope"] == (user, kind)]
        named = [e for e in own if name in e["names"]]
        sims = [(float(np.dot(v, e["v"])), -k) for k, e in enumerate(own)]
        best = max(sims, default=(-1, 0))
        if named:
            entity = named[0]
        elif best[0] >= threshold:
            entity = own[-best[1]]
        else:
            entity = {"scope": (user, kind), "id": i, "names": set(aliases), "v": v}
            entities.append(entity)
        entity["names"].add(name)
        out[i] = entity["id"]
    return out


def test_entities_are_resolved_as_if_one_by_one(spark):
    r = random.Random(7)
    v = vectors(260, dim=8, centres=25, spread=0.2)
    names = [f"name {k}" for k in range(70)]
    mentions = [(k, 1000 - 3 * k, r.choice([None, "u1"]), r.choice(["person", "tool"]), r.choice(names), r.sample(names, r.choice([0, 0, 1, 2])), x.tolist()) for k, x in enumerate(v)]
    schema = "id long, ord long, user_id string, entity_type string, name string, aliases array<string>, embedding array<double>"
    got = write.resolve_mentions(spark.createDataFrame(mentions, schema), 0.92).collect()
    want = resolved(mentions, 0.92)
    assert {x["id"]: x["entity_id"] for x in got} == want and len(got) == len(mentions)
    assert {x["by"] for x in got} == {"new", "name", "alias", "similar"}
    assert all((x["by"] == "new") == (x["id"] == x["entity_id"]) for x in got if x["by"] != "name")


def test_names_are_compared_in_normal_form(spark):
    e1, e2, e3 = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(1, 1, "u", "t", "Café  Noir", ["The CAFE"], e1), (2, 2, "u", "t", "cafe-noir!", [], e2), (3, 3, "u", "t", "the cafe", [], e3), (4, 4, "u", "t", None, None, None), (5, 5, "u", "t", " ", None, e2), (6, 6, "v", "t", "cafe noir", [], e1)]
    df = spark.createDataFrame(rows, "id long, ord long, user_id string, entity_type string, name string, aliases array<string>, embedding array<double>")
    assert {x["id"]: (x["entity_id"], x["by"]) for x in write.resolve_mentions(df).collect()} == {1: (1, "new"), 2: (1, "name"), 3: (1, "alias"), 4: (4, "new"), 5: (4, "name"), 6: (6, "new")}
    assert write.resolve_mentions(df.where("id < 0")).collect() == []


def test_places_running_sums_and_inversions(spark):
    from memlake.operators import temporal

    r = random.Random(2)
    data = [(r.choice([None, "a", "b", "hot", "hot", "hot"]), k, r.randrange(40), r.randrange(5)) for k in range(300)]
    df = spark.createDataFrame(data, "g string, at long, v int, x int").repartition(5)
    by = {}
    for row in sorted(data, key=lambda t: t[1]):
        by.setdefault(row[0], []).append(row)
    got = temporal.places(df, ["g"], ["at"]).collect()
    assert {(x["g"], x["at"]): (x["idx"], x["n"]) for x in got} == {(g, t[1]): (k, len(rows)) for g, rows in by.items() for k, t in enumerate(rows)}
    got = temporal.running(df, ["g"], ["at"], "x", "s").collect()
    assert {(x["g"], x["at"]): x["s"] for x in got} == {(g, t[1]): sum(u[3] for u in rows[:k]) for g, rows in by.items() for k, t in enumerate(rows)}
    got = {x["g"]: x["inversions"] for x in temporal.inversions(df, "g", ["at"], ["v"]).collect()}
    assert got == {g: sum(a[2] > b[2] for i, a in enumerate(rows) for b in rows[i + 1 :]) for g, rows in by.items()}
    got = {x["g"]: x["m"] for x in temporal.upper_median(df, "g", "v", "m").collect()}
    assert got == {g: sorted(t[2] for t in rows)[len(rows) // 2] for g, rows in by.items()}


def test_nearest_in_blocks_by_brute_force(spark):
    """Copies tie by id across blocks; vectors that are null or of another length have a cosine of 0."""
    v = vectors(90, dim=8)
    v[10:40] = v[10]
    odd = [(900, "u", None), (901, "u", []), (902, "u", [1.0, 0.0]), (903, "u", [0.0] * 8)]
    stored = [(k, "u" if k % 5 else "w", x.tolist()) for k, x in enumerate(v)] + odd
    asked = [((k, 1), "u" if k % 3 else None, v[k].tolist()) for k in range(0, 90, 2)] + [((900, 2), "u", None), ((901, 2), "w", [2.0, 0.0])]
    s = spark.createDataFrame(stored, "id long, user_id string, embedding array<double>")
    q = spark.createDataFrame(asked, "question_id struct<a:long,b:long>, user_id string, vector array<double>")

    def cosine(a, b):
        a, b = a or [], b or []
        n = np.linalg.norm(a) * np.linalg.norm(b) if len(a) == len(b) else 0
        return float(np.dot(a, b) / n) if n else 0.0

    for least in (None, 0.5):
        want = {}
        for i, g, x in asked:
            found = sorted((-round(cosine(x, y), 9), k) for k, h, y in stored if g == h)
            want |= {(i, k): -c for c, k in [f for f in found if least is None or -f[0] >= least][:4]}
        got = similarity.nearest(q, s, "user_id", 4, least, block=16).collect()
        assert len(got) == len(want) and {(tuple(r["question_id"]), r["id"]): round(r["similarity"], 9) for r in got} == {k: pytest.approx(c, abs=1e-8) for k, c in want.items()}


def test_stars_in_batches_never_make_all_pairs(spark):
    """One dense group: the sequence is kept over several batches, of which none compares all rows with all."""
    v = vectors(120, centres=3)
    df = spark.createDataFrame([(k, ["u", None][k % 2], 1.0 - k / 1000, x.tolist()) for k, x in enumerate(v)], "id long, user_id string, importance double, embedding array<double>").withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    got = cluster.affinity_clusters(df, "user_id", threshold=0.9, batch=4).collect()
    a = 0.5 * (v @ v.T) + 0.5
    want = one_by_one(range(120), [(i, j) for i in range(120) for j in range(i) if i % 2 == j % 2 and a[i, j] >= 0.9], 3)
    assert {x["id"]: x["cluster"] for x in got} == want and len(want) > 60


def test_stars_along_time_leave_no_rounds_on_disk(spark, monkeypatch):
    """Each row waits for those before it; one witness doesn't decide all turns, so some wait for a further batch."""
    import glob

    from memlake.sources.tables import shared_dir

    monkeypatch.setattr(cluster, "WITNESSES", 1)
    r = random.Random(8)
    hours = sorted(r.random() * 60 for _ in range(150))
    v = vectors(150, centres=2)
    df = spark.createDataFrame([(k, "u", 1.0 - k / 1000, h, x.tolist()) for k, (h, x) in enumerate(zip(hours, v, strict=True))], "id long, user_id string, importance double, hours double, embedding array<double>")
    df = df.withColumn("created_at", F.timestamp_micros((F.col("hours") * 3.6e9).cast("long")))
    at = shared_dir(spark).removeprefix("file://") + "/*/rdd-*"
    before = set(glob.glob(at))
    got = cluster.affinity_clusters(df, "user_id", threshold=0.8, batch=40).collect()
    assert set(glob.glob(at)) == before
    a = 0.5 * (v @ v.T) + 0.5 * np.exp(-0.1 * np.abs(np.subtract.outer(hours, hours)))
    want = one_by_one(range(150), [(i, j) for i in range(150) for j in range(i) if a[i, j] >= 0.8], 3)
    assert {x["id"]: x["cluster"] for x in got} == want and len(want) > 100


def test_candidates_by_bands_are_the_pairs_of_shared_buckets(spark):
    """No pair twice, although copies share every band, and all of them are there; blocks are smaller than buckets."""
    v = vectors(150, dim=8, centres=4)
    v[20:60] = v[20]
    df = rows(spark, v, ["u"] * len(v)).select("id", "embedding")
    q = df.where("id % 10 = 0").withColumnRenamed("id", "query_id")
    got = [(r["query_id"], r["id"]) for r in search.candidates_by_bands(df, q, 8, 0.3, block=8, bands=2, bits=6).collect()]
    codes = {r["id"]: r["codes"] for r in search.sign_bands(df, 8, 2, 6).collect()}
    s = v @ v.T
    want = {(a, b) for a in range(0, 150, 10) for b in range(150) if s[a, b] > 0.3 and any(x == y for x, y in zip(codes[a], codes[b], strict=True))}
    assert len(got) == len(set(got)) and set(got) == want and len(want) < (s[::10] > 0.3).sum()


def test_vectors_without_clusters_are_not_copied_to_cells(spark, monkeypatch):
    """Pivots that would leave nearly all pairs to compare are left out; the pairs are the same."""
    r = np.random.default_rng(3)
    v = r.normal(size=(1200, 64))
    v[7:14] = v[0:7] + 0.01
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    monkeypatch.setattr(similarity, "cells", lambda *a: pytest.fail("copied to cells"))
    got = {(r["a"], r["b"]) for r in similarity.similar_pairs(rows(spark, v, ["u"] * len(v)), 0.92, "user_id").collect()}
    assert got and got == brute(v, ["u"] * len(v), 0.92)


def test_copies_for_cells_leave_in_small_batches():
    """With a radius at which each row visits every cell before its own, no batch has more than SENT rows."""
    v = vectors(3000)
    whole = pa.RecordBatch.from_pydict({"grp": ["u"] * len(v), "id": range(len(v)), "v": v.tolist(), "x": [0.0] * len(v)})
    out = list(similarity.copies(iter([whole]), v[:64], 2.0))
    assert sum(b.num_rows for b in out) > 10 * len(v) and max(b.num_rows for b in out) <= similarity.SENT
    assert sorted(i for b in out for i, home in zip(b["id"].to_pylist(), b["home"].to_pylist(), strict=True) if home) == list(range(len(v)))
