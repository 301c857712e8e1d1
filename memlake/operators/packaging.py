"""Packing results under a token budget, and the text that is handed on."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import text as X
from memlake.functions.scoring import tokens


def citations(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.struct("id", "source_site", F.to_date("created_at").alias("date"), "importance").alias("citation"))


def injection_text(rows: DataFrame, by: str) -> DataFrame:
    """One escaped block of text for each list, in order of rank."""
    line = F.concat(F.lit("<memory id=\""), F.col("id").cast("string"), F.lit("\">"), X.xml_escape(F.col("content")), F.lit("</memory>"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return rows.groupBy(by).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


def tiers(rows: DataFrame, by: str, budget: int, high: float = 0.7, middle: float = 0.4) -> DataFrame:
    """Full text, overview or headline by score, the best first, while the budget lasts: (by, id, tier, cost, text).

    Every row gets its headline at least, also beyond the budget.  A list (by) is a search result, so bounded.
    """
    ready = rows.select(by, "id", "score", F.col("content").alias("t2"), X.overview(F.col("content")).alias("t1"), X.headline(F.col("content")).alias("t0"))
    ready = ready.select("*", *[tokens(F.col(f"t{k}")).alias(f"c{k}") for k in range(3)])

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True], kind="stable")
        left, out = budget, []
        for r in pdf.itertuples():
            k = 2 if r.score >= high and r.c2 <= left else 1 if r.score >= middle and r.t1 != r.t2 and r.c1 <= left else 0
            cost = getattr(r, f"c{k}")
            left -= cost
            out.append((getattr(r, by), r.id, k, cost, getattr(r, f"t{k}")))
        return pd.DataFrame(out, columns=[by, "id", "tier", "cost", "text"])

    t = dict(ready.dtypes)
    return ready.groupBy(by).applyInPandas(assign, f"{by} {t[by]}, id {t['id']}, tier int, cost long, text string")


#: Of a list, at most so many full texts, within this share of the budget; shares of a list for full texts and overviews.
RICH, RICH_BUDGET, RICH_SHARE, SUPPORT_SHARE = 2, 0.6, 0.2, 0.3


def tier_slices(costs: list[tuple[int, int, int]], budget: int) -> list[int]:
    """Tiers of a list in order of rank, from the costs of headline, overview and full text.

    Headlines are taken while they fit; the rest is left out.  Then the first few get their full text
    and the next few their overview, where the budget allows it.
    """
    used = included = 0
    while included < len(costs) and used + costs[included][0] <= budget:
        used += costs[included][0]
        included += 1
    tier = [0] * included
    if not included:
        return tier
    top = min(RICH, max(1, int(included * RICH_SHARE + 0.5)))
    rest = included - top
    support = max(0, rest) if rest <= 1 else min(rest - 1, max(1, int(included * SUPPORT_SHARE)))
    left, rich = budget - used, int(budget * RICH_BUDGET)
    for i in range(top):
        extra = costs[i][2] - costs[i][0]
        if extra <= left and extra <= rich:
            tier[i], left, rich = 2, left - extra, rich - extra
    for i in range(top, min(included, top + support)):
        extra = costs[i][1] - costs[i][0]
        if extra and extra <= left:
            tier[i], left = 1, left - extra
    return tier


def reveal(tier: list[int], costs: list[tuple[int, int, int]], texts: list[tuple[str, str, str]], terms: list[str], budget: int) -> list[int]:
    """Tiers raised, in order of rank, where a query term shows only in a longer text that the budget still allows."""
    tier = list(tier)
    left = budget - sum(costs[i][t] for i, t in enumerate(tier))
    for i, t in enumerate(tier):
        low = [x.lower() for x in texts[i]]
        missing = [w for w in terms if w not in low[t] and w in low[2]]
        options = [(-sum(w in low[k] for w in missing), costs[i][k] - costs[i][t], k) for k in (1, 2) if t != 2 and k != t]
        options = [o for o in options if o[0] and o[1] >= 0]
        fits = [o for o in options if o[1] <= left]
        if fits:
            _, extra, tier[i] = min(fits)
            left -= extra
    return tier


def tiers_by_rank(rows: DataFrame, by: str, budget: int, terms: list[str] | None = None) -> DataFrame:
    """(by, id, tier): tiers by rank in place of score, with ``terms`` raised into view."""
    text = F.col("content")
    ready = rows.select(by, "id", "rank", text.alias("t2"), X.overview(text).alias("t1"), X.headline(text).alias("t0"))
    ready = ready.select("*", *[F.ceil(F.length(f"t{k}") * 0.25).cast("long").alias(f"c{k}") for k in range(3)])

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank", "id"], kind="stable")
        costs = list(zip(pdf["c0"], pdf["c1"], pdf["c2"], strict=True))
        tier = tier_slices(costs, budget)
        if terms:
            tier = reveal(tier, costs, list(zip(pdf["t0"], pdf["t1"], pdf["t2"], strict=True)), terms, budget)
        head = pdf.head(len(tier))
        return pd.DataFrame({by: head[by], "id": head["id"], "tier": tier})

    t = dict(ready.dtypes)
    return ready.groupBy(by).applyInPandas(assign, f"{by} {t[by]}, id {t['id']}, tier int")


def timeline(rows: DataFrame, by: str) -> DataFrame:
    """Dated lines in order; the latest is marked as current."""
    last = F.max(F.struct("created_at", "id")).over(Window.partitionBy(by))
    mark = F.when(F.struct("created_at", "id") == last, " [CURRENT]").otherwise("")
    return rows.select(by, "id", "created_at", F.concat(F.date_format("created_at", "yyyy-MM-dd"), F.lit(": "), X.headline(F.col("content")), mark).alias("line"))
