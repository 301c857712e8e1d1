"""The pipeline against a brute-force version of all its stages."""

import collections
import hashlib
import random
import re

import corpus_pipeline
from memlake.llm import sentencepieces


def brute(rows):
    rows = [r for r in rows if re.search(r"[^\W\d_]", r[1] or "")]
    first = {}
    for r in sorted(rows):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", r[1]), r)
    rows = sorted(first.values())
    sets = {}
    for i, t, _, _ in rows:
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    rows = [r for r in rows if find(r[0]) == r[0]]
    size = {r[0]: len(re.findall("[^\x20\x09-\x0d]+", r[1])) for r in rows}
    by = collections.defaultdict(list)
    for r in rows:
        by[r[3]].append(r[0])
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(by, key=lambda s: (s is None, s or "")))}
    total = {s: sum(size[i] for i in v) for s, v in by.items()}
    budget, full = sum(total.values()), set()
    while True:
        horizon = (budget - sum(3 * total[s] for s in full)) / sum(w for s, w in weight.items() if s not in full)
        more = {s for s in by if s not in full and weight[s] * horizon > 3 * total[s]}
        if not more:
            break
        full |= more
    queue = []
    for s, ids in by.items():
        cum = 0
        key = "n" if s is None else "s" + s
        for i in sorted(ids, key=lambda i: (int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16), i)):
            cum += size[i]
            for e in range(3):
                if size[i] and (e * total[s] + cum - size[i]) / weight[s] < horizon:
                    queue.append(((e * total[s] + cum) / weight[s], key, cum, e, i))
    out, used = [], 0
    for *_, i in sorted(queue):
        used += size[i]
        if used > budget:
            break
        out.append(i)
    return out


def test_pipeline(spark, tables, words):
    import sentencepiece

    r = random.Random(9)
    rows = [(i, words(20 + i % 30), "en" if i % 2 else "de", ["a", "b", "c", None][min(3, i % 7)]) for i in range(60)]
    rows += [(100 + i, rows[i][1].replace(" ", "  "), "en", "a") for i in range(8)]
    for i in range(8):
        w = rows[20 + i][1].split()
        w[r.randrange(len(w))] = "zz"
        rows.append((200 + i, " ".join(w), "en", "b"))
    rows += [(300, None, "en", "a"), (301, "12 34", "en", "a"), (302, "", None, None)]
    got = collections.Counter((x["doc_id"], x["n_tokens"], x["ids_sha256"]) for x in corpus_pipeline.run(spark, tables(rows)).collect())
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.default_model())
    text = {x[0]: x[1] for x in rows}
    want = collections.Counter()
    for i in brute(rows):
        ids = sp.encode(text[i])
        want[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())] += 1
    assert got == want


def test_stages_keep_the_columns(spark, tables, words):
    path = tables([(i, words(12), "en", "a") for i in range(5)])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == spark.read.parquet(f"{path}/documents.parquet").columns


def test_run_keeps_one_stage_at_a_time(spark, tables, words):
    import glob

    from memlake.llm.common import shared_dir

    at = shared_dir(spark).removeprefix("file://") + "/memlake/pipeline-*/*"
    before = set(glob.glob(at))
    corpus_pipeline.run(spark, tables([(i, words(30), "en", "ab"[i % 2]) for i in range(10)]))
    assert [p.split("-")[-1] for p in set(glob.glob(at)) - before] == ["mixing"]


def test_a_large_group_moves_few_sets(spark, words, monkeypatch):
    from memlake.llm import common, ngram_join

    common.ship(spark)
    lines = [words(12) for _ in range(300)]
    # Neighbours share seven of ten lines: one group, in which only the changed copies link.
    text = {i: " ".join(lines[3 * i : 3 * i + 10]) for i in range(96)}
    text |= {1000 + i: text[i] + " end" for i in range(96)}
    moved = []
    opened = ngram_join._opened
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "_opened", lambda blocks, *a: moved.append(blocks.count()) or opened(blocks, *a))
    found = ngram_join.ngram_components(spark.createDataFrame(list(text.items()), "doc_id long, text string")).collect()
    assert {x["id"]: x["component_id"] for x in found} == {i: i % 1000 for i in text}
    # All pairs of the 24 blocks of eight would be some 4800 rows.
    assert sum(moved) < 2400


def test_told_settles_rows_without_a_join(spark):
    from memlake.llm.common import told

    rows = spark.createDataFrame([(i, f"t{i}") for i in [*range(50), None]], "id long, text string")
    verdicts = spark.createDataFrame([(i, None if i == 7 else (i or 0) % 4) for i in [*range(50), None]], "id long, n long")
    sure, others = told(rows, "id", verdicts, 3)
    assert {x["id"]: x["_n"] for x in sure.collect()} == {i: i % 4 for i in range(50) if i % 4 and i != 7}
    assert [x["text"] for x in others.collect()] == ["t7"]
