"""Facts that split, infer and anchor: known cases, then the queries' rows against the rules applied one by one."""

import pytest
from pyspark.sql import functions as F

from memlake import registry
from memlake.functions import facts as X
from memlake.operators import facts as O

SF = "/root/testdata/sf0.001"


def fact(text, *keywords, importance=0.7, kind="knowledge"):
    return X.Fact(text, kind, importance, keywords)


def test_a_recommendation_is_a_fact_of_its_own():
    got = X.normalised(fact("As of January 15, 2026, user is using Supabase for the database and authentication in their project, as recommended by their colleague Jake.", "Supabase", "Jake"))
    assert [x.fact for x in got] == [
        "As of January 15, 2026, user is using Supabase for the database and authentication in their project.",
        "As of January 15, 2026, Jake recommended Supabase for the database and authentication in their project.",
    ]
    assert got[1].type == "person" and got[1].importance == 0.5


def test_a_reason_is_a_fact_of_its_own():
    got = X.normalised(fact("User prefers dark mode because bright screens cause eye strain.", importance=0.6))
    assert [x.fact for x in got] == ["User prefers dark mode.", "User reports that Bright screens cause eye strain."]
    assert got[1].importance == pytest.approx(0.2)


def test_a_change_of_state_has_a_before_and_an_after():
    got = X.normalised(fact("As of March 2026, user switched away from Mem0 and built their own internal AtomicMemory memory engine.", "Mem0", "AtomicMemory", importance=0.8))
    assert [x.fact for x in got] == [
        "As of March 2026, user uses their own internal AtomicMemory memory engine.",
        "As of March 2026, user's current memory backend is their own internal AtomicMemory memory engine.",
        "As of March 2026, user switched away from Mem0.",
    ]
    assert [x.keywords for x in got] == [("AtomicMemory",), ("AtomicMemory", "memory backend", "backend"), ("Mem0",)]
    got = X.normalised(fact("We migrated from MySQL to Postgres.", "MySQL"))
    assert [x.fact for x in got] == ["We use Postgres.", "We previously used MySQL."]


def test_a_pet_has_an_owner():
    (got,) = X.normalised(fact("As of August 23 2023, Oscar, user's guinea pig.", "Oscar"))
    assert got.fact == "As of August 23 2023, user has a guinea pig named Oscar." and "guinea pig" in got.keywords


@pytest.mark.parametrize(
    "text, keywords, entities, relations",
    [
        ("As of January 15 2026, user has been using Tailwind CSS for the last year.", ["Tailwind CSS"], {("User", "person"), ("Tailwind CSS", "tool")}, {("User", "uses", "Tailwind CSS")}),
        (
            "As of February 15 2026, user got some career advice from Dr. Chen at MSR.", ["Dr. Chen", "MSR"],
            {("User", "person"), ("Dr. Chen", "person"), ("Microsoft Research", "organization")}, {("User", "knows", "Dr. Chen"), ("Dr. Chen", "works_at", "Microsoft Research")},
        ),
        (
            "As of January 22 2026, user added Plaid integration for bank account syncing in the finance tracker.", ["Plaid", "finance tracker"],
            {("User", "person"), ("Plaid", "tool"), ("finance tracker", "project")}, {("User", "uses", "Plaid"), ("finance tracker", "uses", "Plaid")},
        ),
    ],
)
def test_entities_and_relations(text, keywords, entities, relations):
    assert entities <= set(X.entities(fact(text, *keywords)))
    assert relations <= set(X.relations(fact(text, *keywords)))


def frame(spark, *rows):
    return spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n int, fact string, type string, importance double, keywords array<string>")


def test_event_anchors(spark):
    rows = [
        ("As of June 16 2023, Jon got mentored yesterday.", "knowledge", 0.5, ["Dr. Jon"]),
        ("As of June 16 2023, user went to Paris.", "knowledge", 0.9, None),
        ("user went to Paris.", "knowledge", 0.9, None),
        ("As of June 16 2023, event anchor trip.paris for User occurred on June 1 2023.", "knowledge", 0.9, []),
        (None, None, None, None),
    ]
    got = {(r["n"], r["fact"]): r for r in O.event_anchors(frame(spark, *rows)).collect()}
    assert set(got) == {
        (0, "As of June 16 2023, event anchor mentorship.received for Dr. Jon occurred on June 15, 2023."),
        (1, "As of June 16 2023, event anchor trip.paris for User occurred on June 16, 2023."),
    }
    assert {r["importance"] for r in got.values()} == {0.85, 0.9}
    both = O.enriched(frame(spark, *rows[1:2], *rows[1:2]), ["n"])
    assert both.count() == 4 and both.columns == ["n", "fact", "type", "importance", "keywords"]


def test_quoted_titles(spark):
    turns = [
        (1, "Jon", '[Session date: 2023-08-23] I am reading "Dune" and "Emma".\nJon read "no".'),
        (2, "user", "My favourite book was 'Heidi'."),
        (3, "Mia", '"The Waves" - they played all night'),
        (4, "Mia", "We were at a Blue Birds concert yesterday."),
        (5, "user", "My advisor Dr Chen is writing my main recommendation letter."),
        (6, "user", None),
    ]
    got = O.quoted(spark.createDataFrame(turns, "n int, role string, text string"), ["n"])
    facts = {(r["n"], r["fact"]) for r in got.collect()}
    assert facts == {
        (1, 'As of August 23 2023, Jon read "Dune".'), (1, 'As of August 23 2023, Jon read "Emma".'), (2, 'user favorite childhood book was "Heidi".'),
        (3, 'Mia saw "The Waves" perform music.'), (4, 'Mia saw "Blue Birds" perform music.'), (5, "Dr. Chen is writing user's main recommendation letter."),
    }
    known = got.where("n = 1 AND fact LIKE '%Dune%'").withColumn("fact", F.upper("fact"))
    assert O.supplemented(known, got, ["n"]).count() == 6


@pytest.mark.parametrize(
    "text, keywords",
    [
        ("The user moved to San Francisco on March 5, 2024 and uses PostgreSQL with GPT-4.", ["March 5, 2024", "San Francisco", "PostgreSQL", "GPT-", "GPT-4"]),
        ("user likes qwen3 models", ["qwen3", "likes", "models"]),
        ("el usuario vive en são paulo", ["são", "paulo"]),
        ("It is what it is.", ["what"]),
        ("A Be Ce De Fe", ["Ce De Fe"]),
        ("Jane's cats; Jane; JANE", ["Jane", "cats"]),
        ("  ", []),
        (None, []),
    ],
)
def test_keywords(text, keywords):
    assert X.keywords(text) == keywords


@pytest.mark.parametrize("name", ["f26_split_facts", "f27_relations", "f27b_entities", "f24_fact_keywords"])
def test_queries_give_what_the_rules_give(spark, name):
    from memlake.plans import facts as P

    rows = (P.rule_facts if name in ("f26_split_facts", "f24_fact_keywords") else P.bare_facts)(spark, SF).collect()
    rule = {"f26_split_facts": X.normalised, "f27_relations": X.relations, "f27b_entities": X.entities, "f24_fact_keywords": lambda f: enumerate(X.keywords(f.fact))}[name]
    want = []
    for r in rows:
        for n, x in enumerate(rule(X._fact(r["fact"], r["type"], r["importance"], r["keywords"]))):
            values = (n, x.fact, x.type, round(x.importance, 6), ",".join(x.keywords)) if isinstance(x, X.Fact) else tuple(x)
            want.append((r["conv_id"], r["turn"], *([] if name == "f26_split_facts" else [r["fact"]]), *values))
    got = [tuple(r) for r in registry.QUERIES[name](spark, SF).collect()]
    assert sorted(got) == sorted(want) and len(want) > 5
