"""Conflict candidates, decisions and lineage on small inputs; the text index against plain search."""

import collections

from pyspark.sql import functions as F

from memlake.operators import lineage, search, textindex

FACT = "fact_id long, user_id string, fact string, embedding array<double>, slot string, importance double, confidence double, keywords array<string>, updated string"
MEMORY = "id long, user_id string, content string, embedding array<double>, slot string, created_at timestamp, importance double, agent_id string"


def frames(spark, facts, memories):
    when = lambda k: __import__("datetime").datetime(2024, 1, 1 + k)
    f = spark.createDataFrame([(i, "u", t, v, s, 0.6, c, [], t + "!") for i, t, v, s, c in facts], FACT)
    m = spark.createDataFrame([(i, u, t, v, s, when(k), 0.5, "a") for k, (i, u, t, v, s) in enumerate(memories)], MEMORY)
    return f, m


def test_candidates_of_three_arms(spark):
    facts = [(1, "The kitchen wallpaper is yellow", [1.0, 0.0], "wall", 0.9), (2, "", None, None, None), (3, "Nothing alike", [-1.0, 0.0], None, None)]
    memories = [(10, "u", "unrelated words", [0.9, 0.1], None), (11, "u", "kitchen wallpaper, bought", [0.0, 1.0], "wall"), (12, "u", "yellow", [0.0, 1.0], "wall"), (13, "v", "kitchen wallpaper yellow", [1.0, 0.0], "wall"), (14, "u", None, None, None)]
    f, m = frames(spark, facts, memories)
    got = {(r["fact_id"], r["id"]): (round(r["similarity"], 4), r["by_slot"]) for r in lineage.candidates(f, m).collect()}
    # Words of fact 1 weigh kitchen 1, wallpaper 1.5, yellow 1.
    assert got == {(1, 10): (0.9939, False), (1, 11): (round(0.45 + 0.44 * 2.5 / 3.5, 4), False), (1, 12): (1.0, True)}
    assert lineage.candidates(f.where("false"), m).collect() == [] and lineage.candidates(f, m.where("false")).collect() == []


def rows(spark, decisions):
    c = "array<struct<o:double,id:bigint,content:string,importance:double,similarity:double,agent_id:string,by_slot:boolean>>"
    data = [(i, "u", t, 0.6, a, target, [(0.0, 7, "old", 0.5, 0.9, "a", False)], t + " more") for i, t, a, target in decisions]
    return spark.createDataFrame(data, f"fact_id long, user_id string, fact string, importance double, action string, target_id long, candidates {c}, updated string")


def test_lineage_of_each_action(spark):
    x = rows(spark, [(1, "new", "ADD", None), (2, "up", "UPDATE", 7), (3, "instead", "SUPERSEDE", 7), (4, "gone", "DELETE", 7), (5, "same", "NOOP", 7), (6, "what", "CLARIFY", 7), (8, "lost", "DELETE", 99)])
    got = lineage.lineage(x).collect()
    assert sorted(map(str, got)) == sorted(map(str, lineage.lineage(x.repartition(3)).collect()))
    by = collections.defaultdict(dict)
    for r in got:
        assert r["table"] not in by[r["fact_id"]]
        by[r["fact_id"]][r["table"]] = r
    kinds = {k: set(v) for k, v in by.items()}
    add = {"memory", "version", "claim", "object", "evidence"}
    assert kinds == {1: add, 8: add, 2: add - {"memory"} | {"closed"}, 3: add | {"closed", "expired"}, 4: {"version", "claim", "object", "closed", "expired"}}
    old = {r["table"]: r for r in lineage.backfill(spark.createDataFrame([("u", 7, "old", 0.5)], "user_id string, id long, content string, importance double")).collect()}
    for k in (2, 3, 4):
        assert by[k]["closed"]["id"] == old["version"]["id"] and by[k]["closed"]["ref"] == by[k]["version"]["id"]
        assert by[k]["claim"]["id"] == by[k]["version"]["ref"] == old["claim"]["id"] and by[k]["claim"]["ref"] == by[k]["version"]["id"]
    assert by[1]["claim"]["id"] != by[8]["claim"]["id"] and by[1]["claim"]["ref"] == by[1]["version"]["id"] and by[1]["object"]["ref"] is None
    assert [by[k]["version"]["content"] for k in (1, 2, 3, 4)] == ["new", "up more", "instead", "[DELETED] gone"]
    assert by[4]["version"]["importance"] == 0 and by[4]["version"]["memory_id"] is None and by[4]["claim"]["mutation"] == "invalid"
    assert by[2]["version"]["memory_id"] == "7" and by[3]["version"]["memory_id"] == by[3]["memory"]["id"] and by[3]["expired"]["id"] == "7"
    assert by[3]["version"]["reason"] == 'Superseded memory "7" with new fact' and by[2]["version"]["reason"] == 'Updated from: "up"'
    assert by[2]["evidence"]["ref"] == by[2]["version"]["id"]


def test_decisions_on_candidates(spark):
    facts = [(1, "I moved the garden shed, no longer using the garden shed", [1.0, 0.0], "shed", 0.95), (2, "A wholly other thing", [0.0, 1.0], None, 0.9), (3, "Their garden shed stays", [1.0, 0.01], "shed", 0.1)]
    memories = [(10, "u", "The garden shed is by the fence", [1.0, 0.0], "shed")]
    f, m = frames(spark, facts, memories)
    got = {r["fact_id"]: r for r in lineage.decided(f, m, lineage.candidates(f, m)).collect()}
    assert (got[2]["given"], got[2]["action"], got[2]["target_id"]) == ("ADD", "ADD", None)
    assert got[1]["given"] in ("DELETE", "SUPERSEDE") and got[1]["target_id"] == 10
    assert (got[3]["given"], got[3]["action"]) == ("CLARIFY", "CLARIFY")


def test_the_index_finds_what_a_search_of_texts_finds(spark, tmp_path):
    texts = ["The cats played in the garden", "cat games; GAMES played", None, "", "garden s", "playing cats " * 50, "Étude café 12"]
    df = spark.createDataFrame([(i, t, i / 10) for i, t in enumerate(texts)], "id long, content string, importance double")
    index = textindex.build(df, keep=("importance",), folder=f"{tmp_path}/index")
    for terms in (["cat"], ["cat", "play"], ["garden"], ["", "garden"], ["12"], ["nowhere"], ["cat", "cat"]):
        plain = [(r["id"], r["rank_score"]) for r in search.keyword_search(df, terms, 10).select("id", "rank_score").collect()]
        got = search.top_k(textindex.matches(spark, index, terms), 10, *search.by_words())
        assert sorted((r["id"], r["rank_score"]) for r in got.collect()) == sorted(plain), terms
    assert textindex.matches(spark, index, ["cat"]).columns == ["id", "importance", "rank_score"]
    empty = textindex.build(df.where("false"), keep=("importance",), folder=f"{tmp_path}/empty")
    assert [t.count() for t in empty.tables(spark)] == [0, 0] and textindex.matches(spark, empty, ["cat"]).collect() == []


def test_no_text_is_read_by_an_indexed_search(spark, tmp_path):
    df = spark.createDataFrame([(i, "the cat of day", 0.5, [1.0, float(i)]) for i in range(50)], "id long, content string, importance double, embedding array<double>")
    stored = df.withColumn("trust", F.lit(1.0)).withColumn("last_accessed_at", F.lit("2024-01-01").cast("timestamp"))
    stored.write.parquet(f"{tmp_path}/m")
    memories = spark.read.parquet(f"{tmp_path}/m")
    index = textindex.build(memories, keep=("importance",), folder=f"{tmp_path}/index")
    out = search.hybrid_search(memories, [1.0, 0.0], ["cat"], 5, "2024-02-01", found=textindex.matches(spark, index, ["cat"])).select("id", "ranking_score")
    scans = out._jdf.queryExecution().sparkPlan().toString()
    assert "FileScan" in scans and "content" not in scans and out.count() == 5


def test_many_questions_through_the_index(spark, tmp_path):
    docs = [(1, "cats play", "u"), (2, "cats cats cats dogs", "u"), (3, "dogs play cats", "v"), (4, None, "u"), (5, "birds", "u")]
    index = textindex.build(spark.createDataFrame(docs, "id long, content string, user string"), keep=("user",), folder=f"{tmp_path}/i")
    asked = spark.createDataFrame([(1, "The cat played", "u"), (2, "dog and cat", "v"), (3, "fish", "u"), (4, "", "u")], "question_id long, text string, user string").withColumn("terms", textindex.terms(F.col("text")))
    got = [(r["question_id"], r["id"], round(r["score"], 4)) for r in textindex.search(asked, index, 2, scope="user").collect()]
    assert sorted(got) == [(1, 1, 0.6667), (1, 2, 0.3333), (2, 3, 0.6667)]
    got = {(r["question_id"], r["id"]) for r in textindex.search(asked, index, 1).collect()}
    assert got == {(1, 1), (2, 2)}


def test_overlaps_in_blocks_by_brute_force(spark):
    """Blocks smaller than the groups, frequent terms, ties, and texts without terms."""
    import random

    from memlake.operators import textindex

    r = random.Random(3)
    words = [f"w{k}" for k in range(12)]
    bag = lambda n: r.sample(words, n)
    asked = [((k, 1), r.choice(["u", "w", None]), t, [1.5 if w > "w5" else 1.0 for w in t], float(len(t))) for k in range(50) for t in [bag(r.choice([0, 1, 4])) if k % 9 else ["gone"]]]
    held = [(k, r.choice(["u", "w", "x"]), t, [r.choice([1, 2]) for _ in t], 20) for k in range(70) for t in [bag(r.choice([0, 2, 6]))]] + [(99, "u", None, None, 0)]
    a = spark.createDataFrame(asked, "question_id struct<a:long,b:long>, grp string, terms array<string>, weights array<double>, total double")
    h = spark.createDataFrame(held, "id long, grp string, terms array<string>, tf array<bigint>, length int")
    want = {}
    for q, g, terms, weights, total in asked:
        found = []
        for i, o, have, tf, n in held:
            at = [(w, tf[have.index(t)]) for t, w in zip(terms, weights, strict=True) if g == o and t in (have or [])]
            if at:
                found.append((-sum(w for w, _ in at), -sum(f for _, f in at) / n, i))
        want |= {(q, i): (-x, total, -y) for x, y, i in sorted(found)[:3]}
    got = {(tuple(x["question_id"]), x["id"]): (x["got"], x["total"], x["often"]) for x in textindex.overlaps(a, h, 3, block=8).collect()}
    assert got == want and len(got) > 40


def test_an_index_is_built_in_parts_that_grow_with_the_texts(spark, tmp_path, monkeypatch):
    from memlake.operators import textindex

    monkeypatch.setattr(textindex, "TEXTS", 4)
    df = spark.createDataFrame([(k, f"common t{k % 5}s t{k % 5}") for k in range(40)] + [(3, "common again")], "id long, content string")
    index = textindex.build(df, folder=str(tmp_path), buckets=2)
    files = [p for p in (tmp_path / "postings").rglob("*.parquet")]
    assert len(files) > 4  # not one for each bucket
    got = {r["id"]: r["rank_score"] for r in textindex.matches(spark, index, ["common"], buckets=2).collect()}
    assert got == {k: 1 / 3 if k != 3 else 2 / 5 for k in range(40)}
