"""Operators 11 to 13 against brute force: nulls, ties, repeated rows, long texts, odd columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from memlake.llm import infill, merkle, packing, registry

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
duckdb = pytest.importorskip("duckdb")

Q, SQL = registry.queries(), registry.oracle_sql()
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def by_sql(path, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    out = con.execute(SQL[name])
    return sorted((dict(zip([c[0] for c in out.description], r, strict=True)) for r in out.fetchall()), key=str)


def same_as_sql(spark, path, name):
    got = [r.asDict() for r in Q[name](spark, path).collect()]
    assert sorted(({k: r[k] for k in sorted(r)} for r in got), key=str) == sorted(({k: r[k] for k in sorted(r)} for r in by_sql(path, name)), key=str)
    return got


# Merkle manifest ---------------------------------------------------------------------------------


def tree(nodes):
    """All levels of a tree over nodes."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][k : k + 16]) for k in range(0, len(out[-1]), 16)])
    return out


def siblings(levels, at):
    """(left, right) on each level above a node."""
    for level in levels[:-1]:
        run = level[at // 16 * 16 : at // 16 * 16 + 16]
        yield run[: at % 16], run[at % 16 + 1 :]
        at //= 16


def manifest(rows):
    """By id: the query's columns, one step at a time."""
    one = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, text, lang, source: H(*map(one, (i, source, lang, None if text is None else len(text), text)))
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[3]].append((r[0], leaf(*r), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[1] for x in sorted(groups[s], key=lambda x: (x[0], x[1]))]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for n, s in enumerate(order):
        for at, (i, node, (_, text, lang, source)) in enumerate(sorted(groups[s], key=lambda x: (x[0], x[1]))):
            steps = [*siblings(trees[s], at), *siblings(top, n)]
            low = text.translate(str.maketrans(merkle.UPPER, merkle.LOWER)) if text and zlib.crc32(str(i).encode()) % 5 == 0 else text
            folded = leaf(i, low, lang, source) if low == text else H(*map(one, (i, source, lang, len(text), low)))
            for left, right in steps:
                folded = H(*left, folded, *right)
            out.append((i, node, trees[s][-1][0], top[-1][0], H(*[x for left, right in steps for x in left + right]), folded, folded == top[-1][0]))
    return sorted(out)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def merkle_rows(words):
    r = random.Random(6)
    sources = [None, "", "é", "z", "n", "big", *[f"s{k}" for k in range(20)]]
    rows = [(i, r.choice([None, "", "Aé" + words(3), words(5).title()]), r.choice([None, "en"]), r.choice(sources)) for i in range(300)]
    rows += [(1000 + i, f"Text {i}", "en", "big") for i in range(300)]  # three levels
    return [*rows, (2000, "only", "en", "lone"), (2001, "x" * 100_000 + "É", "en", "big")]


def test_manifest(spark, tables, words):
    rows = merkle_rows(words)
    path = tables(rows)
    got = same_as_sql(spark, path, "op11_merkle")
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == manifest(rows)
    assert 0 < sum(not r["verified"] for r in got) < len(got) / 4


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257])
def test_manifest_of_one_group(spark, tables, n):
    rows = [(i, f"T{i}", None, "s") for i in range(n)]
    got = Q["op11_merkle"](spark, tables(rows)).select(*COLUMNS).collect()
    assert sorted(map(tuple, got)) == manifest(rows)


def test_manifest_of_repeated_rows(spark, tables):
    """Equal rows are leaves of their own; rows of one id go by digest."""
    rows = [(5, "a", "en", "s")] * 20 + [(5, "B", "en", "s"), (3, None, None, "s"), (3, None, None, "s")]
    got = Q["op11_merkle"](spark, tables(rows)).select(*COLUMNS).collect()
    assert sorted(map(tuple, got)) == manifest(rows)


def test_manifest_finds_what_changed(spark, tables, words):
    rows = merkle_rows(words)
    docs = [spark.read.parquet(f"{tables(x)}/documents.parquet") for x in (rows, [r for r in rows if r[0] != 2000], [(r[0], "new" if r[0] == 1007 else r[1], *r[2:]) for r in rows])]
    nodes = [merkle.manifest(d)[0] for d in docs]
    assert merkle.changed(nodes[0], nodes[0]).count() == 0
    assert {(r["grp"], r["new"]) for r in merkle.changed(nodes[0], nodes[1]).collect()} == {("slone", None)}
    assert [r["grp"] for r in merkle.changed(nodes[0], nodes[2]).collect()] == ["sbig"]
    assert nodes[0].where("tree = 'root' AND n = 1").count() == 1


# Packing -----------------------------------------------------------------------------------------


def test_pieces_are_the_documents(spark, tables, words):
    r = random.Random(8)
    texts = [None, "", " \t", "x", words(5000), words(2047), "é́ a\x1cb <|endoftext|> don't ''s ²½ŸİΣς", "語" * 3000, *[words(r.randrange(1, 900)) for _ in range(120)]]
    path = tables([(i, t, "en", "s") for i, t in enumerate(texts)] + [(8, texts[8], "en", "s")])
    encode = tokenizers.Tokenizer.from_file(TOKENIZER).encode
    ids = {i: np.array([*encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in enumerate(texts)}
    got = Q["op12_packing"](spark, path).collect()
    rows, places = collections.defaultdict(list), collections.defaultdict(list)
    for x in got:
        piece = ids[x["doc_id"]][x["start"] : x["start"] + x["length"]]
        assert len(piece) == x["length"] > 0 and x["doc_tokens"] == len(ids[x["doc_id"]]) and x["ids_crc32"] == zlib.crc32(piece.tobytes())
        rows[x["doc_id"]].append((x["start"], x["length"]))
        places[x["sequence_id"]].append((x["offset"], x["length"]))
    for i, own in ids.items():
        covered = sorted(k for start, n in rows[i] for k in range(start, start + n))
        assert covered == sorted([*range(len(own))] * (2 if i == 8 else 1))
    for p in places.values():
        p.sort()
        assert [o for o, _ in p] == [sum(n for _, n in p[:k]) for k in range(len(p))]
        n = sum(n for _, n in p)
        assert n == 2048 or n & (n - 1) == 0 and n < 2048
    assert sorted(got) == sorted(Q["op12_packing"](spark, path).collect())
    docs = spark.read.parquet(f"{path}/documents.parquet")
    whole = packing.sequences(packing.pack(docs, TOKENIZER)).collect()
    assert all(len(s["ids"]) == 4 * s["tokens"] == 4 * sum(p["length"] for p in s["parts"]) for s in whole)
    assert packing.padding(packing.pack(docs, TOKENIZER)).first()["padding"] == 0


def test_placement_is_the_least_sum_of_squares():
    """Each item goes where a plain search over all windows puts it."""
    r = random.Random(9)
    packer, count = packing.SumOfSquares(32, 10**9), collections.Counter()
    for k in range(3000):
        size = r.randrange(1, 32)

        def squares(level, size=size):
            after = count.copy()
            after[level] -= level > 0
            after[level + size] += level + size < 32
            return sum(v * v for v in after.values())

        best = min([h for h in range(1, 33 - size) if count[h] > 0] + [0], key=lambda h: (squares(h), h == 0, -h))
        # A new window only where it is better than any open one.
        assert packer.level_for(size) == best
        count[best] -= best > 0
        count[best + size] += best + size < 32
        packer.add(k, 0, np.zeros(size, np.uint32))
        assert [packer.count[h] for h in range(32)] == [count[h] for h in range(32)] == [len(o) for o in [[]] + packer.open[1:]]


@pytest.mark.parametrize("most", [4, 1000])
def test_items_that_never_fit_are_cut(most):
    """All items of more than half a window: none fits another, and still no place is lost."""
    packer, closed = packing.SumOfSquares(32, most), []
    for k in range(99):
        closed += packer.add(k, 0, np.full(20, k, np.uint32))
    assert packer.count.sum() < most
    closed += packer.close()
    sizes = [sum(len(ids) for _, _, ids in w) for w in closed]
    assert sum(sizes) == 99 * 20 and all(n & (n - 1) == 0 for n in sizes) and packer.close() == []
    items = collections.Counter()
    for w in closed:
        for tag, start, ids in w:
            assert len(ids) and (ids == tag).all() and start + len(ids) <= 20
            items[tag] += len(ids)
    assert items == dict.fromkeys(range(99), 20)


def test_encoder_is_the_library():
    r = random.Random(1)
    letters = "ab ZéÁÿÝµªº²¹¼¿«×÷ÐÞþ¶\xad\xa1 ́̈ΑΣς''s<|>\t\n\x0b\x0c\r　\xa0日本٣½ǅß İ\U0001f600#$%0123‍ͅ각\x1c\x00"
    encode, own = tokenizers.Tokenizer.from_file(TOKENIZER).encode, packing.Encoder(TOKENIZER)
    for _ in range(4000):
        text = "".join(r.choice(letters) for _ in range(r.randrange(30))) + r.choice(["", "", "<|endoftext|>x", " <|startoftext|>", "'LL 've"])
        assert own(text).tolist() == encode(text, add_special_tokens=False).ids


# Fill in the middle ------------------------------------------------------------------------------

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def test_infill(spark, tables, words):
    r = random.Random(12)
    odd = [None, "", " ", "\n\t", "a", " a ", "<P>", "x <S> y", "<M", "<<S>", "é b\xa0c\x1cd", "\U0001f600 \U0001f600", "<P <S <M>", "a" * 50_000 + " b", "　"]
    rows = [(i, r.choice(odd), None, None) for i in range(300)] + [(300 + i, words(r.randrange(1, 60)) + r.choice(["", " ", "\n"]), None, "s") for i in range(300)] + [(301, "again", None, None)] * 2
    path = tables(rows)
    got = same_as_sql(spark, path, "op13_infill")
    assert len(got) == len(rows)
    texts = collections.defaultdict(list)
    for i, t, *_ in rows:
        texts[i].append(t or "")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    made = infill.transform(docs).withColumn("back", infill.restore(F.col("output"), F.col("form"))).collect()
    forms = collections.Counter()
    for x in made:
        forms[x["form"]] += 1
        assert x["back"] in texts[x["id"]]
        units = UNIT.findall(x["back"])
        h = hashlib.sha256(f"42:{x['id']}".encode()).hexdigest()
        a, b, c, d = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
        n = len(units)
        k, m = sorted((a % (n + 1), b % (n + 1)))
        prefix, middle, suffix = "".join(units[:k]), "".join(units[k:m]), "".join(units[m:])
        form = "plain" if not x["back"] or re.search("<[PSM]>", x["back"]) or c % 100 >= 50 else "spm" if d % 100 < 80 else "psm"
        want = {"plain": x["back"], "spm": f"<S>{suffix}<P>{prefix}<M>{middle}", "psm": f"<P>{prefix}<S>{suffix}<M>{middle}"}[form]
        size = (None, None) if form == "plain" else (len(prefix), len(middle))
        assert (x["n"], x["form"], x["prefix_chars"], x["middle_chars"], x["output"]) == (n, form, *size, want)
    assert min(forms.values()) > 20 and len(forms) == 3
