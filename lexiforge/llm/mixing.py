"""Mixing sources to target weights by iterative proportional fitting (operator 1), with DataFrame functions only.

Documents are counted in cells of source, language and topic. A budget of tokens is
to be drawn from them so that its parts by source, by language and by topic are
those of the targets. Raking scales the cells in turn by what each source, each
language and each topic lacks or has too much, until all three hold at once. A cell
gives all it has at most: its scale beyond 1 counts as 1, and the next rounds make up
for that in the other cells. The scale, 1 at most, is the probability with which a
cell's documents are sampled. Whether a document is in the sample is a hash of seed
and id: the same in every run.

Defined results: null categories are one category ``(none)``; categories that a
target doesn't name have weight 0 and are never sampled. Null and empty texts have 0
tokens and the probability of their cell. Rows that repeat an id are sampled together,
and so are all rows without one. Targets that the documents can't meet are met as
nearly as ``MAX_ROUNDS`` rounds come; ``mixture_report`` tells which, and by how
much. Empty tables give empty results. Other columns pass.

Only cells are shuffled during raking. Up to ``FEW_CELLS`` of them stand in one
partition; beyond, each step is a sum by category that is joined back, so no task has
all cells or all of a language. They are broadcast to the documents if there are at
most ``FEW_CELLS`` and their names are short; else they are joined, and adaptive
execution splits a hot cell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiforge.llm.storage import settle, table, unused

DIMENSIONS = ("source", "lang", "topic")
#: Unless given, targets are the present shares to this power: large categories give to small ones.
TEMPERATURE = 0.9
#: Unless given, the budget is this part of all tokens.
BUDGET_SHARE = 0.8
#: Raking ends when a job's rounds change no cell by more than this part of the budget.
TOLERANCE = 1e-12
ROUNDS_A_JOB = 3
MAX_ROUNDS = 60
#: Scales of cells that can't give enough grow no further.
LARGEST_SCALE = 1e15
FEW_CELLS, BROADCAST_LETTERS = 50_000, 4_000_000
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"
#: A text's topic by its form, unless a column has it. Valid in Spark and DuckDB.
TOPIC = """CASE WHEN 8 * (length(text) - length(replace(text, '|', ''))) > n_tokens AND n_tokens > 0 THEN 'table'
  WHEN n_tokens < 100 THEN 'note' WHEN n_tokens < 1000 THEN 'article' ELSE 'book' END"""


def measured(docs: DataFrame, columns: Sequence[str], id_col: str = "doc_id", text_col: str = "text", topic_col: str | None = None) -> DataFrame:
    """(columns, _id, source, lang, topic, n_tokens) of each row: its id, its categories and its words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("(none)"))
    rows = docs.select(*columns, F.col(id_col).alias("_id"), none("source").alias("source"), none("lang").alias("lang"), *([none(topic_col).alias("topic")] if topic_col else []), text.alias("text"), F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long").alias("n_tokens"))
    return (rows if topic_col else rows.withColumn("topic", F.expr(TOPIC))).drop("text")


def tempered(cells: DataFrame, dimension: str, power: float = TEMPERATURE) -> DataFrame:
    """(dimension, target) from the present shares of tokens."""
    return cells.groupBy(dimension).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("target"))


def with_goals(cells: DataFrame, targets: dict[str, DataFrame], budget: float) -> DataFrame:
    """``cells`` with the tokens that each dimension's category is to have in the sample, as ``goal_<dimension>``."""
    for d, target in targets.items():
        whole = target.agg(F.sum("target").alias("_whole"))  # one row
        goal = target.crossJoin(F.broadcast(whole)).select(d, (F.lit(float(budget)) * F.col("target") / F.nullif("_whole", F.lit(0.0))).alias(f"goal_{d}"))
        cells = cells.join(goal, d, "left").withColumn(f"goal_{d}", F.coalesce(f"goal_{d}", F.lit(0.0)))
    return cells


def expected() -> Column:
    """Tokens that a cell has in the sample, on average."""
    return F.col("tokens") * F.least(F.lit(1.0), F.col("scale"))


def scaled(cells: DataFrame, dimension: str, few: bool) -> DataFrame:
    """One step: all cells of a category are scaled by its goal over what it has."""
    if few:
        had = F.sum(expected()).over(Window.partitionBy(dimension))
    else:
        cells = cells.join(cells.groupBy(dimension).agg(F.sum(expected()).alias("_had")), dimension)
        had = F.col("_had")
    scale = F.when(had > 0, F.least(F.lit(LARGEST_SCALE), F.col("scale") * F.col(f"goal_{dimension}") / had)).otherwise(F.col("scale"))
    return cells.withColumn("scale", scale).drop("_had")


def rake(cells: DataFrame, targets: dict[str, DataFrame], budget: float) -> DataFrame:
    """``cells`` (dimensions, tokens) with goals and ``scale``."""
    few = cells.count() <= FEW_CELLS
    cells = with_goals(cells, targets, budget).withColumn("scale", F.lit(1.0))
    cells = settle(cells.coalesce(1) if few else cells)
    a_job = ROUNDS_A_JOB if few else 1
    for _ in range(0, MAX_ROUNDS, a_job):
        cells = cells.withColumn("_was", expected())
        for d in [*targets] * a_job:
            cells = scaled(cells, d, few)
        cells = settle(cells)
        moved = cells.agg(F.max(F.abs(expected() - F.col("_was")))).first()[0]
        cells = cells.drop("_was")
        if (moved or 0.0) <= TOLERANCE * budget:
            break
    return cells


def chance(id_: Column, seed: str = SEED) -> Column:
    """A number from 0 to 1 that depends on seed and id only."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def calibrated(counted: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float | None = None) -> DataFrame:
    """(dimensions, tokens, goals, weight, probability) of each cell of ``counted`` (dimensions, n_tokens); targets: of each dimension (category, ``target``)."""
    cells = settle(counted.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")))
    if budget is None:
        budget = BUDGET_SHARE * (cells.agg(F.sum("tokens")).first()[0] or 0)
    raked = rake(cells, targets or {d: tempered(cells, d) for d in DIMENSIONS}, budget)
    weight = F.coalesce(expected() / F.nullif(F.lit(float(budget)), F.lit(0.0)), F.lit(0.0))
    return settle(raked.withColumns({"weight": weight, "probability": F.least(F.lit(1.0), F.col("scale"))}).drop("scale"))


def mixture_report(cells: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(dimension, category, goal, tokens, met) from calibrated ``cells``: what each category was to have and has in the sample on average."""
    parts = []
    for d in DIMENSIONS:
        if f"goal_{d}" in cells.columns:
            sums = cells.groupBy(F.col(d).alias("category")).agg(F.first(f"goal_{d}").alias("goal"), F.sum(F.col("tokens") * F.col("probability")).alias("tokens"))
            parts.append(sums.select(F.lit(d).alias("dimension"), "category", "goal", "tokens", (F.abs(F.col("tokens") - F.col("goal")) <= tolerance * F.col("goal")).alias("met")))
    report = parts[0]
    for part in parts[1:]:
        report = report.union(part)
    return report


def mix(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """``rows`` (_id, dimensions) with their cell's weight and probability, and ``sampled``."""
    cells = cells.select(*DIMENSIONS, "weight", "probability")
    size = cells.agg(F.count("*").alias("n"), F.coalesce(F.sum(sum(F.length(d) for d in DIMENSIONS)), F.lit(0)).alias("letters")).first()
    if size["n"] <= FEW_CELLS and size["letters"] <= BROADCAST_LETTERS:
        cells = F.broadcast(cells)
    return rows.join(cells, [*DIMENSIONS]).withColumn("sampled", chance(F.col("_id")) < F.col("probability"))


def sample_mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: dict[str, DataFrame] | None = None, budget: float | None = None, topic_col: str | None = None) -> DataFrame:
    """The sampled rows of ``docs``, as they were; targets: of each dimension (category, ``target``); budget: tokens (words) to draw."""
    row = unused(docs, "_row")
    packed = docs.withColumn(row, F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    rows = measured(packed, [row], id_col, text_col, topic_col)
    return mix(rows, calibrated(rows, targets, budget)).where("sampled").select(f"{row}.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    rows = settle(measured(docs, []))
    found = mix(rows, calibrated(rows))
    return found.select(F.col("_id").alias("doc_id"), *DIMENSIONS, "n_tokens", F.round("weight", 8).alias("weight"), F.round("probability", 6).alias("probability"), "sampled")


def op1_sql() -> str:
    """The same by all rounds, each step a common table expression."""
    steps, last = [], "c0"
    for k in range(MAX_ROUNDS):
        for d in DIMENSIONS:
            name, had = f"{d[0]}{k + 1}", f"sum(tokens * least(1.0, scale)) OVER (PARTITION BY {d})"
            steps.append(f"{name} AS MATERIALIZED (SELECT source, lang, topic, tokens, goal_source, goal_lang, goal_topic, CASE WHEN {had} > 0 THEN least({LARGEST_SCALE}, scale * goal_{d} / {had}) ELSE scale END AS scale FROM {last})")
            last = name
    targets = ",\n".join(f"t_{d} AS MATERIALIZED (SELECT {d}, (SELECT budget FROM b) * pow(sum(tokens), {TEMPERATURE}) / sum(pow(sum(tokens), {TEMPERATURE})) OVER () AS goal_{d} FROM c GROUP BY {d})" for d in DIMENSIONS)
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, coalesce(text, '') AS text,
         CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS n_tokens FROM documents),
k AS MATERIALIZED (SELECT doc_id, source, lang, n_tokens, {TOPIC} AS topic FROM d),
c AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM k GROUP BY ALL),
b AS MATERIALIZED (SELECT {BUDGET_SHARE} * sum(tokens) AS budget FROM c),
{targets},
c0 AS MATERIALIZED (SELECT *, CAST(1 AS DOUBLE) AS scale FROM c JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic)),
{",".join(steps)},
p AS (SELECT source, lang, topic, tokens * least(1.0, scale) / (SELECT budget FROM b) AS weight, least(1.0, scale) AS probability FROM {last})
SELECT doc_id, k.source, k.lang, k.topic, n_tokens, round(weight, 8) AS weight, round(probability, 6) AS probability,
       ('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT / 4294967296.0 < probability AS sampled
FROM k JOIN p ON k.source = p.source AND k.lang = p.lang AND k.topic = p.topic
"""


OP1_SQL = op1_sql()
