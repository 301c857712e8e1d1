"""Personal data by bootstrapped contextual extraction (operator 9), in DataFrame operations only.

Well-formed e-mail addresses, IP addresses, card and phone numbers are found by pattern (the base).
They are the seeds: the one or two words before and after them, and the word on either side together,
induce lexical patterns, a bipartite graph links patterns with the identifier-shaped tokens in their
places, and scores are passed to and fro between the two sides until they no longer change: a pattern
is as good as the share of its places that hold good instances, an instance as good as the patterns
around it.  Patterns of high confidence then discover identifiers of other shapes, reported as spans
of kind ``context``.

What a candidate is: a token with a digit whose core has 7 to 128 characters, 7 letters or digits and 2
digits at least; its context are the words within 64 characters.  The base patterns know no such bounds.

Scale: one pass over the texts writes, for each document, its spans and candidate tokens (a small
fraction of the text); what is iterated is the graph of distinct (pattern, instance) pairs.  A
pattern or token that is everywhere is pre-aggregated before its shuffle, and joins with scores are
plain ones that Spark can split.  All regular expressions run in linear time.

Defined results: a null text is empty; documents without findings have counts 0, the digest of the
empty string and empty spans; repeated rows are treated apart; ties of a span's start are in the
order e-mail, ip, card, phone, context; texts of any length are searched whole; further columns are
ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.common import NOT_WS, Scratch, blocks, documents, let

# The base patterns, in forms that Java's engine matches without recursion or repeated scans: a run
# of a pattern's first characters is entered only at its start or where the last match ended.
LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
KINDS = ("email", "ip", "card", "phone")
CONTEXT = "context"

#: Candidate tokens: ASCII-white-space-delimited, with a digit.
TOKEN = rf"(?<!{NOT_WS})[^\x20\x09-\x0D0-9]*+[0-9]{NOT_WS}*+"
#: Shape of a candidate: length, letters and digits, and digits at least.
SHORTEST, LONGEST, ALNUM, DIGITS = 7, 128, 7, 2
#: Good instances a pattern needs; score at which a pattern counts and an instance is reported.
SUPPORT, CONFIDENT, REPORTED = 3, 0.5, 0.6
#: Characters on each side of a token that its context is taken from.
NEAR = 64


_PLACED = "array<struct<start:bigint,text:string>>"


def _located(text: Column, regex: str, found: Column) -> Column:
    """Matches with their start: array<struct<start,text>>, from the gaps that splitting leaves.

    Starts are running sums of lengths, taken block by block: an array that grows item by item is
    copied every time, so it must stay short.
    """
    none = F.array().cast(_PLACED)

    def place(block: Column, offset: Column) -> Column:
        start = F.struct(offset.cast("long").alias("at"), none.alias("out"))
        step = lambda acc, x: F.struct(
            (acc["at"] + F.length(x["g"]) + F.length(x["m"])).cast("long").alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(x["g"])).cast("long").alias("start"), x["m"].alias("text")))).alias("out"),
        )
        return F.aggregate(block, start, step)["out"]

    def by_block(cut: Column) -> Column:
        sizes = F.transform(cut, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda a, x: a + F.length(x["g"]) + F.length(x["m"])))
        offsets = F.aggregate(sizes, F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
        return F.flatten(F.zip_with(cut, F.slice(offsets, F.lit(1), F.size(cut)), place))

    pairs = F.zip_with(F.slice(F.split(text, regex, -1), F.lit(1), F.size(found)), found, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    return F.when(F.size(found) > 0, let(blocks(pairs), by_block)).otherwise(none)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]+", "")


def _luhn(x: Column) -> Column:
    """Whether digits pass Luhn: from the right, every second one doubled, its digits summed."""
    d = F.transform(F.filter(F.split(F.reverse(x), ""), lambda c: c != ""), lambda c, i: c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1))
    return F.aggregate(d, F.lit(0), lambda a, v: a + F.when(v > 9, v - 9).otherwise(v)) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return x.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        n = F.length(_digits(x))
        return (n >= 14) & (n <= 19) & _luhn(_digits(x))
    if kind == "phone":
        n = F.length(_digits(x))
        return (n >= 10) & (n <= 15)
    return F.lit(True)


#: In the order by which spans sort.
_SPAN = "array<struct<start:bigint,kind:int,stop:bigint>>"


def _spans(kind: str, number: int) -> Column:
    """The valid ones of a kind's located matches."""

    def span(s: Column) -> Column:
        return F.struct(s["start"].alias("start"), F.lit(number).alias("kind"), (s["start"] + F.length(s["text"])).cast("long").alias("stop"))

    return F.transform(F.filter(f"_p_{kind}", lambda s: _valid(kind, s["text"])), span).cast(_SPAN)


def base_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with _text (never null) and _base: valid spans of all kinds, sorted by start, then kind."""
    rows = docs.withColumn("_text", F.coalesce(F.col(text_col), F.lit("")))
    text = F.col("_text")
    digit = text.rlike("[0-9]")
    none = F.array().cast("array<string>")
    guards = {"email": text.contains("@"), "ip": digit, "card": digit, "phone": text.contains("+")}
    regex = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
    for k in KINDS:
        rows = rows.withColumn(f"_m_{k}", F.when(guards[k], F.regexp_extract_all(text, F.lit(regex[k]), F.lit(0))).otherwise(none))
    parts = []
    for i, k in enumerate(KINDS):
        rows = rows.withColumn(f"_p_{k}", _located(text, regex[k], F.col(f"_m_{k}")))
        parts.append(_spans(k, i))
    rows = rows.withColumn("_base", F.array_sort(F.concat(*parts)))
    return rows.drop(*[f"_{a}_{k}" for a in "mp" for k in KINDS])


def candidates(rows: DataFrame) -> DataFrame:
    """rows with _cand: candidate tokens with their place, the words around them and whether a base span overlaps."""
    text = F.col("_text")
    rows = rows.withColumn("_tok", F.when(text.rlike("[0-9]"), F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("_gap", F.when(F.size("_tok") > 0, F.split(text, TOKEN, -1)))
    rows = rows.withColumn("_at", _located(text, TOKEN, F.col("_tok")))
    extent = lambda b: F.struct(F.array_min(b)["start"].alias("start"), F.array_max(F.transform(b, lambda s: s["stop"])).alias("stop"), b.alias("spans"))
    rows = rows.withColumn("_blocks", F.when(F.size("_base") > 0, F.transform(blocks(F.col("_base")), extent)).otherwise(F.array().cast(f"array<struct<start:bigint,stop:bigint,spans:{_SPAN}>>")))

    def one(t: Column, i: Column, spans: Column) -> Column:
        # The core of a token: without a name before = or :, without punctuation at the ends.
        named = F.regexp_extract(t["text"], r"^([A-Za-z_]{2,32})[=:].", 1)
        rest = F.substring(t["text"], F.when(named != "", F.length(named) + 2).otherwise(1), F.length(t["text"]))
        lead = F.length(F.regexp_extract(rest, r"^([^\p{L}\p{N}+]*)", 1))
        core = F.regexp_replace(F.substring(rest, lead + 1, F.length(rest)), r"[^\p{L}\p{N}]++$", "")
        start = t["start"] + F.length(t["text"]) - F.length(rest) + lead
        before, after = F.element_at(F.col("_gap"), i + 1), F.element_at(F.col("_gap"), i + 2)
        words = lambda x: F.regexp_extract_all(F.lower(x), F.lit(r"(\p{L}+)"), F.lit(1))
        ahead, behind = words(F.right(before, F.lit(NEAR))), words(F.left(after, F.lit(NEAR)))
        left = F.when(named != "", F.array(F.lower(named))).otherwise(F.slice(ahead, F.greatest(F.size(ahead) - 1, F.lit(1)), F.lit(2)))
        word_after = F.slice(behind, 1, 2)
        stop = start + F.length(core)
        near = lambda b: (b["start"] < stop) & (start < b["stop"])
        seed = F.exists(spans, lambda x: near(x) & F.exists(x["spans"], near))
        return F.struct(start.cast("long").alias("start"), stop.cast("long").alias("stop"), core.alias("core"), left.alias("left"), word_after.alias("right"), seed.alias("seed"))

    n = lambda c: F.length(F.regexp_replace(c["core"], r"[^\p{L}\p{N}]+", ""))
    shaped = lambda c: c["seed"] | ((F.length(c["core"]) >= SHORTEST) & (F.length(c["core"]) <= LONGEST) & (n(c) >= ALNUM) & (F.length(_digits(c["core"])) >= DIGITS))
    cand = let(F.col("_blocks"), lambda b: F.filter(F.transform("_at", lambda t, i: one(t, i, b)), shaped))
    return rows.withColumn("_cand", cand).drop("_tok", "_gap", "_at", "_blocks")


def patterns(left: Column, right: Column) -> Column:
    """Lexical patterns of a place: the nearest word on each side, the two nearest, and one on either side."""
    one_left, one_right = F.try_element_at(left, F.lit(-1)), F.try_element_at(right, F.lit(1))
    two = lambda words: F.when(F.size(words) == 2, F.array_join(words, " "))
    made = F.array(F.concat(F.lit("<"), one_left), F.concat(F.lit("<"), two(left)), F.concat(F.lit(">"), one_right), F.concat(F.lit(">"), two(right)), F.concat(one_left, F.lit("|"), one_right))
    return F.filter(made, lambda p: p.isNotNull())


def confident_instances(cands: DataFrame, scratch: Scratch) -> DataFrame:
    """(core, score) of unseeded instances that confident patterns surround.

    cands: (core, left, right, seed), one row for each place.  Scores only ever rise from round to
    round and are rounded, so the rounds end.
    """
    sides = cands.select("core", "seed", F.explode(patterns(F.col("left"), F.col("right"))).alias("pattern"))
    edges = sides.groupBy("pattern", "core").agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed"))
    edges = scratch.keep(edges, "edges")
    score, state = None, None
    while True:
        # Patterns: the share of places held by good instances, and how many good instances speak for them.
        e = edges if score is None else edges.join(score, "core", "left")
        known = F.lit(0.0) if score is None else F.coalesce(F.col("score"), F.lit(0.0))
        e = e.withColumn("good", F.when(F.col("seed"), 1.0).otherwise(known))
        pattern = e.groupBy("pattern").agg(F.sum(F.col("n") * F.col("good")).alias("hits"), F.sum("n").alias("places"), F.count_if(F.col("good") >= REPORTED).alias("support"))
        pattern = pattern.where(F.col("support") >= SUPPORT).select("pattern", F.round(F.col("hits") / F.col("places"), 6).alias("p"))
        pattern = scratch.keep(pattern.where(F.col("p") >= CONFIDENT), "patterns")
        # Instances: as good as the best confident pattern they stand in.
        fresh = edges.where("NOT seed").join(pattern, "pattern").groupBy("core").agg(F.max("p").alias("score"))
        old, score = score, scratch.keep(fresh.where(F.col("score") >= CONFIDENT), "instances")
        scratch.drop(pattern, *([old] if old is not None else []))
        now = score.agg(F.count(F.lit(1)), F.sum(F.col("score").cast("decimal(20,6)"))).first()
        if now == state:
            return score.where(F.col("score") >= REPORTED)
        state = now


def _joined(spans: Column, names: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, found): spans of the base and of the contexts, as arrays of (start, kind, stop), for every row."""
    scratch = Scratch(docs.sparkSession, "pii")
    rows = candidates(base_spans(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_t")), "_t"))
    # The row number is made once and written, so it is the same for all that reads it.
    rows = scratch.keep(rows.select("id", F.monotonically_increasing_id().alias("row"), F.col("_base").alias("base"), F.col("_cand").alias("cand")), "rows")
    cands = rows.select("row", F.explode("cand").alias("c")).select("row", "c.*")
    good = scratch.keep(confident_instances(cands, scratch).select("core"), "good")
    new = cands.where("NOT seed").join(good, "core").select("row", F.struct("start", F.lit(len(KINDS)).alias("kind"), "stop").alias("s"))
    new = new.groupBy("row").agg(F.collect_set("s").alias("found"))
    out = rows.select("id", "row", "base").join(new, "row", "left")
    return out.select("id", "base", F.coalesce(F.col("found"), F.array().cast(_SPAN)).alias("found"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(documents(spark, sf_dir))
    names = F.array(*map(F.lit, [*KINDS, CONTEXT]))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        F.col("id").alias("doc_id"),
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(_joined(F.col("base"), names).cast("binary"), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", "found")), names).alias("spans"),
    )
