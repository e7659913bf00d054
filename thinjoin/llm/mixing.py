"""Mixing sources to target weights by iterative proportional fitting.

Token counts are aggregated into the cells of source, language and topic. Raking scales the cells to the target shares
of one margin after the other until all margins agree, or the weights no longer get closer. A cell's fitted weight over
its tokens, relative to the largest such ratio, is the probability with which its documents are sampled: expected tokens
then stand in the fitted proportions, and no probability exceeds one. Only DataFrame functions are used. The cells, not
the documents, take part in the iterations; plans don't grow with them. A document is drawn by a hash of its id.

Defined results: a null source, language or topic is the category ``(none)``. Documents without a word carry no weight;
they have probability 0. A category without a given target has the share 0, targets without documents are ignored and
the rest is scaled to 1. Targets that no weights of the occurring cells can meet together (sources of one language only)
are met by the margin raked last, topic, and missed by others: ``margin_gap`` states the largest difference of a share
from its target in every row, and a warning is given. Rows with equal ``doc_id`` have equal draws; rows without one are drawn by their text. An empty
table gives no rows. Extra columns pass through.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thinjoin.llm.common import packed, table
from thinjoin.session import settle

MARGINS = ("source", "lang", "topic")
#: Default targets: a category's share of tokens to this power. Below one, small categories gain.
TEMPER = {"source": 0.7, "lang": 0.8, "topic": 0.9}
NONE = "(none)"
ITERATIONS = 40
TOLERANCE = 1e-10
#: After ``ITERATIONS`` rounds raking goes on while a round's change is at most this share of the last one's.
SHRINKS = 0.99
#: Pairs of language and topic up to which a source's cells stand in one row.
PAIRS = 1 << 14
#: Gap between margins and targets above which raking warns.
MARGIN_GAP = 1e-6
WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix"


def topic_of(text: Column, tokens: Column) -> Column:
    """A coarse topic from the surface of the text, where the table brings none."""
    bars = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    calls = F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))
    return (
        F.when(text.contains("icensed under"), "legal")
        .when(bars * 4 > tokens, "listing")
        .when(calls * 4 > tokens, "calls")
        .when(tokens < 200, "note")
        .when(tokens < 1000, "article")
        .otherwise("report")
    )


def measured(docs: DataFrame) -> DataFrame:
    """(row, text, source, lang, topic, tokens): the margins' categories and the words of each row."""
    held = {c: F.col(f"row.`{c}`").cast("string") for c in MARGINS if c in docs.columns}
    text = F.coalesce("text", F.lit(""))
    rows = packed(docs).withColumn("tokens", F.regexp_count(text, F.lit(WORD)).cast("long"))
    held.setdefault("topic", topic_of(text, F.col("tokens")))
    categories = [F.coalesce(held.get(c, F.lit(None).cast("string")), F.lit(NONE)).alias(c) for c in MARGINS]
    return rows.select("row", "text", *categories, "tokens")


def tempered(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """(category, target) shares: tokens of the category to the power."""
    return cells.groupBy(F.col(margin).alias("category")).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("target"))


def scaled_targets(cells: DataFrame, targets: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """(category, target) for the categories that occur, scaled to 1."""
    scaled = {}
    for m in MARGINS:
        there = cells.select(F.col(m).alias("category")).distinct().join(targets[m], "category", "left").fillna(0.0, ["target"])
        there = settle(there, f"target-{m}")
        whole = there.agg(F.sum("target")).first()[0] or 1.0
        scaled[m] = there.select("category", (F.col("target") / F.lit(whole)).alias("target"))
    return scaled


def rake(cells: DataFrame, targets: Mapping[str, DataFrame], iterations: int = ITERATIONS, tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` (MARGINS, tokens) with ``weight``: token shares fitted to the target shares of every margin.

    ``targets`` has (category, target) for each margin; they are scaled to 1 over the categories that occur.
    ``iterations`` rounds are run, unless the weights stand still before, and more as long as the change shrinks.
    ``margin_gap``, the same in all rows, is what the margins then lack.
    """
    scaled = scaled_targets(cells, targets)
    pairs = cells.select(*MARGINS[1:]).distinct().count()
    fit = rake_by_factors if 0 < pairs <= PAIRS else rake_by_joins
    now, done = fit(cells, scaled, iterations, tolerance)
    gap = margin_gap(now, scaled)
    if gap > MARGIN_GAP:
        warnings.warn(f"targets not met: a margin is {gap:.3g} off its target after {done} rounds", stacklevel=2)
    return now.withColumn("margin_gap", F.lit(gap))


def goes_on(done: int, iterations: int, change: float | None, last: float | None, tolerance: float) -> bool:
    if change is None or change <= tolerance:
        return False
    return done < iterations or last is None or change <= SHRINKS * last


def rake_by_factors(cells: DataFrame, scaled: Mapping[str, DataFrame], iterations: int, tolerance: float) -> tuple[DataFrame, int]:
    """Raked cells, and the rounds it took, where languages and topics are few.

    A cell's weight is its tokens times a factor of its source, its language and its topic, and the source's factor follows from the other
    two. So a round is one aggregate: each source finds its factor from its own cells, the cells are summed by
    language and topic, and the one row of these sums gives the next factors. Sources may be many; only the few factors
    of languages and topics pass from one round to the next.
    """
    long, first, second = MARGINS
    names, wanted = {}, {}
    for m in (first, second):
        rows = scaled[m].orderBy("category").collect()
        names[m] = F.array(*[F.lit(r["category"]) for r in rows])
        wanted[m] = F.array(*[F.lit(r["target"]) for r in rows])
    whole = cells.agg(F.sum("tokens")).first()[0] or 1
    cell = F.struct(
        F.array_position(names[first], F.col(first)).cast("int").alias("a"),
        F.array_position(names[second], F.col(second)).cast("int").alias("b"),
        "tokens",
        (F.col("tokens") / F.lit(whole)).alias("w"),
    )
    targets = scaled[long].select(F.col("category").alias(long), "target")
    # a source's cells: as many as there are pairs of language and topic, at most
    held = cells.join(targets, long).groupBy(long, "target").agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    held = settle(held, "cells")

    def ratio(of: Column, to: Column) -> Column:
        return F.when(to > 0, of / to).otherwise(0.0)

    def total(entries: Column, value) -> Column:
        return F.aggregate(entries, F.lit(0.0), lambda so_far, e: so_far + value(e))

    def factors_of(margin: str, own: str, other: str, others: Column) -> Column:
        """Targets of a margin's categories over the sums of their cells."""
        to = lambda i: total(F.filter("sums", lambda e: e[own] == i), lambda e: e["m"] * F.element_at(others, e[other]))
        return F.transform(F.sequence(F.lit(1), F.size(wanted[margin])), lambda i: ratio(F.element_at(wanted[margin], i), to(i)))

    def of_source(one: Column, two: Column) -> Column:
        mass = total(F.col("cells"), lambda e: e["w"] * F.element_at(one, e["a"]) * F.element_at(two, e["b"]))
        return ratio(F.col("target"), mass)

    state = {m: [1.0] * len(scaled[m].collect()) for m in (first, second)}
    last, done = None, 0
    while True:
        one, two = (F.array(*[F.lit(x) for x in state[m]]) for m in (first, second))
        rows = held.select(of_source(one, two).alias("f"), F.explode("cells").alias("c"))
        sums = rows.groupBy("c.a", "c.b").agg(F.sum(F.col("c.w") * F.col("f")).alias("m"))
        sums = sums.agg(F.sort_array(F.collect_list(F.struct("a", "b", "m"))).alias("sums"))
        step = sums.withColumn(first, factors_of(first, "a", "b", two))
        found = step.withColumn(second, factors_of(second, "b", "a", F.col(first))).select(first, second).first()
        before, state, done = state, {m: list(found[m]) for m in (first, second)}, done + 1
        change = max((abs(x - y) / max(x, y) for m in state for x, y in zip(state[m], before[m], strict=True) if max(x, y) > 0), default=None)
        if not goes_on(done, iterations, change, last, tolerance):
            break
        last = change
    one, two = (F.array(*[F.lit(x) for x in before[m]]) for m in (first, second))
    rows = held.select(long, of_source(one, two).alias("f"), F.explode("cells").alias("c"))
    after = [F.element_at(F.array(*[F.lit(x) for x in state[m]]), F.col(f"c.{k}")) for m, k in ((first, "a"), (second, "b"))]
    categories = [F.element_at(names[m], F.col(f"c.{k}")).alias(m) for m, k in ((first, "a"), (second, "b"))]
    weight = (F.col("c.w") * F.col("f") * after[0] * after[1]).alias("weight")
    return settle(rows.select(long, *categories, F.col("c.tokens").alias("tokens"), weight), "cells"), done


def rake_by_joins(cells: DataFrame, scaled: Mapping[str, DataFrame], iterations: int, tolerance: float) -> tuple[DataFrame, int]:
    """Raked cells, and the rounds it took, for any number of categories: the cells themselves take part in every round."""
    scaled = {m: settle(t, f"target-{m}") for m, t in scaled.items()}
    whole = cells.agg(F.sum("tokens")).first()[0] or 1
    now = settle(cells.select(*MARGINS, "tokens", (F.col("tokens") / F.lit(whole)).alias("weight")), "cells")
    last, done = None, 0
    while True:
        step = now.withColumn("before", F.col("weight"))
        for m in MARGINS:
            sums = step.groupBy(F.col(m).alias("category")).agg(F.sum("weight").alias("sum")).join(scaled[m], "category")
            factor = F.when(F.col("sum") > 0, F.col("target") / F.col("sum")).otherwise(0.0).alias("factor")
            step = step.join(sums.select(F.col("category").alias(m), factor), m)
            step = step.withColumn("weight", F.col("weight") * F.col("factor")).drop("factor")
        fitted = settle(step, "cells")
        change = fitted.agg(F.max(F.abs(F.col("weight") - F.col("before")))).first()[0]
        now, done = fitted.drop("before"), done + 1
        if not goes_on(done, iterations, change, last, tolerance):
            return now, done
        last = change


def margin_gap(fitted: DataFrame, targets: Mapping[str, DataFrame]) -> float:
    """The largest difference between the weight of a category, of any margin, and its target."""
    gaps = None
    for m in MARGINS:
        sums = fitted.groupBy(F.col(m).alias("category")).agg(F.sum("weight").alias("sum"))
        off = sums.join(targets[m], "category").select(F.abs(F.col("sum") - F.col("target")).alias("off"))
        gaps = off if gaps is None else gaps.unionByName(off)
    return gaps.agg(F.coalesce(F.max("off"), F.lit(0.0))).first()[0]


def probabilities(fitted: DataFrame) -> DataFrame:
    """(MARGINS, probability) of every cell."""
    ratio = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)
    rated = fitted.select(*MARGINS, ratio.alias("ratio"))
    top = rated.agg(F.max("ratio")).scalar()
    chance = F.when(F.col("ratio") > 0, F.col("ratio") / top).otherwise(0.0)
    return rated.select(*MARGINS, chance.alias("probability"))


def draw(doc_id: Column, text: Column) -> Column:
    """A uniform number in [0, 1) that depends on the id, or the text of a row without one."""
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), key)), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def mix(docs: DataFrame, targets: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """(row, text, source, lang, topic, tokens, probability, margin_gap, sampled) for every row of ``docs``."""
    rows = measured(docs)
    cells = settle(rows.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")), "cell-tokens")
    targets = targets or {m: tempered(cells, m, p) for m, p in TEMPER.items()}
    fitted = rake(cells, targets)
    chances = settle(probabilities(fitted).join(fitted.select(*MARGINS, "margin_gap"), list(MARGINS)), "probabilities")
    joined = rows.join(chances, list(MARGINS), "left")
    chance = F.when(F.col("tokens") > 0, F.coalesce("probability", F.lit(0.0))).otherwise(0.0)
    joined = joined.withColumn("probability", chance)
    sampled = draw(F.col("row.doc_id"), F.col("text")) < F.col("probability")
    return joined.select("row", "text", *MARGINS, "tokens", "probability", "margin_gap", sampled.alias("sampled"))


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    found = mix(table(spark, folder, "documents").select("doc_id", "text", "source", "lang"))
    return found.select("row.doc_id", *MARGINS, "tokens", F.round("probability", 6).alias("probability"), "sampled")


def _sql() -> str:
    step = "cells"
    for m in MARGINS:
        step = f"(SELECT * EXCLUDE (w), w * (SELECT target FROM target_{m} t WHERE t.category = c.{m}) / sum(w) OVER (PARTITION BY {m}) AS w FROM {step} c)"
    targets = ",\n".join(
        f"""target_{m} AS (
  SELECT {m} AS category, pow(sum(tokens)::DOUBLE, {p}) / sum(pow(sum(tokens)::DOUBLE, {p})) OVER () AS target FROM start GROUP BY {m})"""
        for m, p in TEMPER.items()
    )
    return f"""
WITH RECURSIVE counted AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang,
         CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS tokens
  FROM documents
), rows AS (
  SELECT doc_id, source, lang, tokens, CASE WHEN contains(text, 'icensed under') THEN 'legal'
    WHEN (length(text) - length(replace(text, '|', ''))) * 4 > tokens THEN 'listing'
    WHEN (length(text) - length(replace(text, '!', ''))) * 4 > tokens THEN 'calls'
    WHEN tokens < 200 THEN 'note' WHEN tokens < 1000 THEN 'article' ELSE 'report' END AS topic
  FROM counted
), start AS (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens FROM rows GROUP BY ALL),
{targets},
cells AS (
  SELECT 0 AS i, source, lang, topic, tokens, tokens::DOUBLE / sum(tokens) OVER () AS w FROM start
  UNION ALL
  SELECT i + 1, source, lang, topic, tokens, w FROM {step} WHERE i < {ITERATIONS}
), chances AS (
  SELECT source, lang, topic, (w / tokens) / max(w / tokens) OVER () AS p FROM cells WHERE i = {ITERATIONS} AND tokens > 0
)
SELECT doc_id, source, lang, topic, tokens, round(CASE WHEN tokens > 0 THEN p ELSE 0 END, 6) AS probability,
       CASE WHEN tokens > 0 THEN CAST(CAST('0x' || substr(md5('{SEED}:' || doc_id), 1, 8) AS UBIGINT) AS DOUBLE) / {1 << 32}.0 < p ELSE false END AS sampled
FROM rows LEFT JOIN chances USING (source, lang, topic)
"""


ORACLE = _sql()
