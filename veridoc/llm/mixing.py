"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Token weights are summed to cells of source, language and topic. Every value of these margins
has a target share of the tokens to draw, given by the caller or made from the present shares, and a
factor. A cell's part of what is drawn is its present part times its three factors, but no more
than all it has. Raking scales the factors of one margin after the other to its targets until
none is missed by more than a tolerance, or sweeps no longer help. A document is drawn if a uniform number made from
its id lies below its probability: the budget times its three factors, at most 1.

A cell that saturates gives all it has, and the rest of its share goes to the other cells of
its source, language and topic. A target that is more than all tokens of the value is cut to
these, and what is over goes to the other values in proportion to their targets. Targets that
can't be met together (a language that one saturated source has alone) are missed.

Cells are as many as combinations of marginal values, not as documents: sums are partial
before the shuffle, so a source with a third of all rows is a row per map task. Cells are
counted: up to a bound they are raked in one task and their rates are broadcast; beyond it, sums by margin are
partial again, and rows meet their rate by a join that a hot cell doesn't skew.

Nulls in source, language or topic, and empty strings, form the value ``(none)``; a table
without such a column has that value throughout, but for the topic, which is then told from
the text's form. Null and empty texts weigh nothing and have probability 1. Rows that
repeat an id are drawn together. An empty table gives no rows. Columns named like the results
are replaced; columns may have any names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from veridoc.llm.common import checkpointed, fresh, skew_join

MARGINS = ("source", "lang", "topic")
#: Without given targets, target shares are present shares to this power: 1 keeps the mix, 0 makes values equal.
TEMPERATURE = {"source": 0.5, "lang": 0.7, "topic": 0.8}
#: Wanted part of all tokens; the largest miss of a target at which raking ends; sweeps over the margins at most.
BUDGET, TOLERANCE, SWEEPS = 0.5, 1e-4, 60
#: Sweeps between looks at what is missed; raking ends when these leave more of it than this part.
SWEEPS_A_CHECK, STALLED = 4, 0.8
#: Cells that one task rakes, and that may be broadcast.
FEW_CELLS = 100_000
SEED = "mix-1"

#: Where there is no topic column: a class by surface form, in SQL that both engines read.
TOPIC = "CASE WHEN contains({t}, ' | ') THEN 'table' WHEN contains({t}, '!!') THEN 'shout' WHEN contains({t}, '@') OR contains({t}, '://') THEN 'contact' WHEN length({t}) >= 8000 THEN 'long' WHEN length({t}) >= 1500 THEN 'middle' ELSE 'short' END"

Targets = dict[str, dict[str, float]]


def token_weight(text: Column) -> Column:
    """A token weight without a tokenizer: words between single spaces and line feeds, 0 for an empty text."""
    t = F.coalesce(text, F.lit(""))
    spaces = F.length(t) - F.length(F.translate(t, " \n", ""))
    return F.when(F.length(t) == 0, F.lit(0)).otherwise(spaces + 1).cast("long")


def _margins(df: DataFrame, column: str) -> dict[str, Column]:
    def value(c: str) -> Column:
        if c not in df.columns:
            return F.lit("(none)")
        text = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
        return F.when(text == "", "(none)").otherwise(text)

    form = F.expr(TOPIC.format(t=f"coalesce(`{column}`, '')"))
    return {"source": value("source"), "lang": value("lang"), "topic": value("topic") if "topic" in df.columns else form}


def described(df: DataFrame, id_col: str = "doc_id", column: str = "text") -> DataFrame:
    """The id, the margins' values and the token weight of each row; no text goes on."""
    return df.select(F.col(f"`{id_col}`").alias("id"), *(v.alias(m) for m, v in _margins(df, column).items()), token_weight(F.col(f"`{column}`")).alias("n_tokens"))


def check_targets(targets: Targets | None) -> Targets:
    for margin, shares in (targets or {}).items():
        if margin not in MARGINS:
            raise ValueError(f"no margin {margin!r}")
        if any(not 0 <= x <= 1 for x in shares.values()) or sum(shares.values()) > 1 + 1e-9:
            raise ValueError(f"shares of {margin!r} must lie between 0 and 1 and add up to 1 at most")
    return targets or {}


def target_shares(cells: DataFrame, margin: str, total: float, budget: float, given: dict[str, float] | None, temperature: float) -> DataFrame:
    """``(value, target)`` of a margin: no value has more than all its tokens.

    Values that ``given`` doesn't list divide what it leaves in proportion to their tokens.
    """
    present = cells.groupBy(F.col(margin).alias("value")).agg(F.sum("tokens").alias("tokens"))
    if given is None:
        weighed = present.withColumn("weight", F.pow(F.col("tokens").cast("double"), F.lit(temperature)))
    else:
        listed = cells.sparkSession.createDataFrame([(str(k), float(v)) for k, v in given.items()], "value string, share double")
        weighed = checkpointed(present.join(listed, "value", "left"))
        rest = weighed.filter("share IS NULL").agg(F.sum("tokens")).first()[0] or 1
        left = max(0.0, 1.0 - sum(given.values()))
        weighed = weighed.withColumn("weight", F.coalesce("share", F.col("tokens") * left / rest)).drop("share")
    weighed = checkpointed(weighed.withColumn("most", F.col("tokens") / (budget * total)))
    # values that can't have their share have all they can; the others divide the rest
    scale, full = 0.0, F.lit(False)
    while True:
        held, weight, n = weighed.agg(F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)).first()
        if not weight:
            break
        scale, known = max(0.0, 1.0 - (held or 0.0)) / weight, n
        full = F.col("weight") * F.lit(scale) >= F.col("most")
        if weighed.filter(full).count() == known:
            break
    return checkpointed(weighed.select("value", F.least(F.col("most"), F.col("weight") * F.lit(scale)).alias("target")))


def _drawn(u: str | Column, most: str | Column) -> Column:
    return F.least(F.col(u) if isinstance(u, str) else u, F.col(most) if isinstance(most, str) else most)


def _ended(missed: float, before: float, tolerance: float) -> bool:
    return missed < tolerance or missed > STALLED * before


def _rake_few(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int, tolerance: float) -> DataFrame:
    """Cells with ``u``, raked in one task: a sum over a margin is a window there, and nothing is shuffled."""
    for m in MARGINS:
        cells = cells.join(targets[m].select(F.col("value").alias(m), F.col("target").alias(f"target_{m}")), m)
    cells, before = checkpointed(cells.withColumn("u", F.col("part"))), float("inf")
    for _ in range(sweeps // SWEEPS_A_CHECK):
        out, gaps = cells.coalesce(1), []
        for k in range(SWEEPS_A_CHECK):
            for m in MARGINS:
                total = F.sum(_drawn("u", "most")).over(Window.partitionBy(m))
                out = out.withColumn("s", total)
                if k == SWEEPS_A_CHECK - 1:
                    gaps.append(f"gap_{m}")
                    out = out.withColumn(gaps[-1], F.abs(F.col("s") - F.col(f"target_{m}")))
                out = out.withColumn("u", F.col("u") * F.col(f"target_{m}") / F.col("s"))
        seen = Observation()
        cells = checkpointed(out.observe(seen, F.max(F.greatest(*gaps)).alias("gap")).drop("s", *gaps))
        missed = seen.get["gap"] or 0.0
        if _ended(missed, before, tolerance):
            break
        before = missed
    return cells


def _rake_many(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int, tolerance: float) -> DataFrame:
    """The same by a factor for each value: a step joins the cells with the factors and sums them by one margin, with partial sums before the shuffle.

    Spark broadcasts the factors of a margin if their written size is below its threshold.
    """
    factors = {m: t.withColumn("factor", F.lit(1.0)) for m, t in targets.items()}

    def raked() -> DataFrame:
        out = reduce(lambda df, m: df.join(factors[m].select(F.col("value").alias(m), F.col("factor").alias(f"factor_{m}")), m), MARGINS, cells)
        return out.withColumn("u", reduce(lambda x, m: x * F.col(f"factor_{m}"), MARGINS, F.col("part")))

    before = float("inf")
    for _ in range(sweeps // SWEEPS_A_CHECK):
        for _ in range(SWEEPS_A_CHECK):
            missed = 0.0
            for m in MARGINS:
                sums = raked().groupBy(F.col(m).alias("value")).agg(F.sum(_drawn("u", "most")).alias("s"))
                seen = Observation()
                step = factors[m].join(sums, "value").select("value", "target", (F.col("factor") * F.col("target") / F.col("s")).alias("factor"), F.abs(F.col("s") - F.col("target")).alias("gap"))
                factors[m] = checkpointed(step.observe(seen, F.max("gap").alias("gap")), FEW_CELLS).drop("gap")
                missed = max(missed, seen.get["gap"] or 0.0)
        if _ended(missed, before, tolerance):
            break
        before = missed
    return checkpointed(raked())


def rake(cells: DataFrame, budget: float = BUDGET, targets: Targets | None = None, temperature: dict[str, float] = TEMPERATURE, sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Of ``cells`` (the margins and ``tokens``) those with tokens, with ``probability``, the rate at which their documents are wanted; and ``(value, target)`` of each margin."""
    given = check_targets(targets)
    cells = checkpointed(cells.filter("tokens > 0"))
    n, total = cells.agg(F.count(F.lit(1)), F.sum("tokens").cast("double")).first()
    total = total or 1.0
    shares = {m: target_shares(cells, m, total, budget, given.get(m), temperature[m]) for m in MARGINS}
    wanted = reduce(lambda df, m: skew_join(df, shares[m].filter("target > 0").select(F.col("value").alias(m), F.lit(True).alias(f"wanted_{m}")), m), MARGINS, cells)
    wanted = checkpointed(wanted.filter(" AND ".join(f"wanted_{m}" for m in MARGINS)).select(*MARGINS, "tokens", (F.col("tokens") / total).alias("part"), (F.col("tokens") / (budget * total)).alias("most"))) if given else cells.withColumns({"part": F.col("tokens") / total, "most": F.col("tokens") / (budget * total)})
    raked = (_rake_few if n <= FEW_CELLS else _rake_many)(wanted, shares, sweeps, tolerance)
    rate = F.round(F.least(F.lit(1.0), F.lit(budget) * F.col("u") / F.col("part")), 9)
    raked = raked.select(*MARGINS, rate.alias("probability"))
    if given:  # a target of 0 draws nothing
        raked = cells.join(raked, list(MARGINS), "left").select(*MARGINS, F.coalesce("probability", F.lit(0.0)).alias("probability"))
    return checkpointed(raked), shares


def uniform(id_col: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from an id: 52 bits of an MD5 digest."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _with_probability(df: DataFrame, rates: DataFrame, values: dict[str, Column], n_tokens: Column, out: str, cell: str) -> DataFrame:
    """Append the probability of each row's cell."""
    rates = rates.select(F.struct(*MARGINS).alias(cell), F.col("probability").alias(out))
    df = df.withColumn(cell, F.struct(*(v.alias(m) for m, v in values.items())))
    df = df.join(F.broadcast(rates), cell, "left") if rates.limit(FEW_CELLS + 1).count() <= FEW_CELLS else skew_join(df, rates, cell)
    return df.withColumn(out, F.when(n_tokens > 0, F.col(out)).otherwise(F.lit(1.0)))


def rates(docs: DataFrame, budget: float = BUDGET, targets: Targets | None = None) -> DataFrame:
    return rake(docs.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")), budget, targets)[0]


def draw(df: DataFrame, id_col: str = "doc_id", column: str = "text", budget: float = BUDGET, seed: str = SEED, targets: Targets | None = None) -> DataFrame:
    """Per row: id, margins, ``n_tokens``, ``probability`` and ``drawn``.

    ``targets`` gives, by margin and value, the wanted share of the drawn tokens; 0 draws none.
    """
    docs = described(df, id_col, column)
    out = _with_probability(docs, rates(docs, budget, targets), {m: F.col(m) for m in MARGINS}, F.col("n_tokens"), "probability", "cell")
    out = out.withColumn("drawn", uniform(F.col("id"), seed) < F.col("probability"))
    return out.select(F.col("id").alias(id_col), *MARGINS, "n_tokens", "probability", "drawn")


def mix(df: DataFrame, id_col: str = "doc_id", column: str = "text", budget: float = BUDGET, seed: str = SEED, targets: Targets | None = None) -> DataFrame:
    """The drawn rows, with the input's columns. The rate is looked up beside the row, so texts aren't shuffled but where there are too many cells to broadcast."""
    cell, probability = fresh(df, "cell", "probability")
    rate = rates(described(df, id_col, column), budget, targets)
    out = _with_probability(df, rate, _margins(df, column), token_weight(F.col(f"`{column}`")), probability, cell)
    return out.filter(uniform(F.col(f"`{id_col}`"), seed) < F.col(probability)).select(*(f"`{c}`" for c in df.columns))


# -- the same in DuckDB -----------------------------------------------------------------------


def sql(table: str = "documents", id_col: str = "doc_id", column: str = "text", budget: float = BUDGET, sweeps: int = SWEEPS, tolerance: float = TOLERANCE, seed: str = SEED) -> str:
    """DuckDB SQL for :func:`draw` over a table or a parenthesized query, without given targets."""
    t = f"coalesce({column}, '')"
    ctes = [
        f"""docs AS (SELECT {id_col} AS id, coalesce(nullif(source, ''), '(none)') AS source, coalesce(nullif(lang, ''), '(none)') AS lang, {TOPIC.format(t=t)} AS topic,
        CASE WHEN length({t}) = 0 THEN 0 ELSE length({t}) - length(replace(replace({t}, ' ', ''), chr(10), '')) + 1 END AS n_tokens FROM {table})""",
        "cells AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM docs GROUP BY 1, 2, 3 HAVING sum(n_tokens) > 0)",
    ]
    for m in MARGINS:
        # values ascend in tokens as in the part of their share that they can have: the first k are cut for the least k that leaves enough to the next
        ctes.append(
            f"""v_{m} AS MATERIALIZED (SELECT {m}, sum(tokens) AS tokens, pow(sum(tokens), {TEMPERATURE[m]}) AS weight, sum(tokens) / ({budget} * (SELECT sum(tokens) FROM cells)) AS most FROM cells GROUP BY 1),
        o_{m} AS MATERIALIZED (SELECT *, (1 - sum(most) OVER w + most) / (sum(weight) OVER () - sum(weight) OVER w + weight) AS scale FROM v_{m} WINDOW w AS (ORDER BY tokens, {m} ROWS UNBOUNDED PRECEDING)),
        t_{m} AS MATERIALIZED (SELECT {m}, least(most, weight * coalesce((SELECT arg_min(scale, tokens) FROM o_{m} WHERE weight * scale < most), 0)) AS target_{m} FROM v_{m})"""
        )
    inner = f"SELECT * FROM raked WHERE gap >= {tolerance} AND gap <= {STALLED} * before AND k < {sweeps // SWEEPS_A_CHECK}"
    for k in range(SWEEPS_A_CHECK):
        for m in MARGINS:
            gap = f"abs(s - target_{m})" if m == MARGINS[0] else f"greatest(miss, abs(s - target_{m}))"
            inner = f"SELECT * EXCLUDE (u, s, miss), u * target_{m} / s AS u, {gap} AS miss FROM (SELECT *, sum(least(most, u)) OVER (PARTITION BY {m}) AS s FROM ({inner}))"
    columns = "source, lang, topic, part, most, target_source, target_lang, target_topic, u"
    ctes.append(
        f"""raked AS (SELECT 0 AS k, source, lang, topic, tokens / (SELECT sum(tokens) FROM cells) AS part, tokens / ({budget} * (SELECT sum(tokens) FROM cells)) AS most, target_source, target_lang, target_topic, tokens / (SELECT sum(tokens) FROM cells) AS u,
        CAST(1 AS DOUBLE) AS gap, CAST(9 AS DOUBLE) AS before, CAST(0 AS DOUBLE) AS miss
        FROM cells JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic)
        UNION ALL SELECT k + 1, {columns}, max(miss) OVER (), CASE WHEN k = 0 THEN 1e9 ELSE gap END, CAST(0 AS DOUBLE) FROM ({inner}))"""
    )
    ctes.append(f"rates AS MATERIALIZED (SELECT source, lang, topic, round(least(1.0, {budget} * u / part), 9) AS rate FROM raked WHERE k = (SELECT max(k) FROM raked))")
    uniform_sql = f"CAST(CAST('0x' || substr(md5('{seed}:' || coalesce(CAST(id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / {float(1 << 52)!r}"
    return f"""WITH RECURSIVE {', '.join(ctes)} SELECT id AS {id_col}, source, lang, topic, CAST(n_tokens AS BIGINT) AS n_tokens, probability, {uniform_sql} < probability AS drawn
        FROM (SELECT docs.*, CASE WHEN n_tokens > 0 THEN rate ELSE CAST(1 AS DOUBLE) END AS probability FROM docs LEFT JOIN rates USING (source, lang, topic))"""
