"""Operator 7: mixing to target weights by iterative proportional fitting.

Documents fall in cells by source, language and topic. The tokens of each cell are raked to target
shares of each of the three in turn, within a budget of tokens and never above what a cell has. The
probability of a document is its cell's raked weight over the cell's tokens; a document is sampled
where a hash of its id, uniform in [0, 1), lies below it.

Targets are given as shares, or follow from the shares that the corpus has. What is fitted is the
table of cells, one for each combination that occurs, on the driver. Its size is bounded by contract:
more than ``MAX_CELLS`` are an error, and finer sources then have to be grouped by the caller. A cell
that is wholly sampled can leave its targets unmet; :func:`marginals` reports targets and what is met.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark.plans.session import cut, position, positional, prepare, release, small_or_hashed

DIMENSIONS = ("source", "lang", "topic")
#: Target share of a value: its share of the tokens to this power, made to sum to one.
EXPONENTS = {"source": 0.7, "lang": 0.8, "topic": 0.9}
#: Tokens to sample, as a share of all.
BUDGET = 0.75
ROUNDS = 10
#: Raking ends before its last round once each marginal is this near to its target, relative to it.
TOLERANCE = 1e-12
SEED = "mix-1"
MAX_CELLS = 1_000_000
#: Topics and the pattern that tells each; a text has the topic with most matches, the first of equals,
#: if there is one match in ``TOPIC_WORDS`` words at least, and else ``OTHER_TOPIC``.
TOPICS = (("tabular", r"\|"), ("emphatic", "!"), ("numeric", "[0-9]+"), ("legal", "[Ll]icen[sc]e|[Cc]opyright"), ("contact", "@"))
TOPIC_WORDS = 50
OTHER_TOPIC = "prose"
WORD = r"[^ \t\n\r\f]+"


def token_count(text: Column) -> Column:
    """Words by white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _matches(text: Column, pattern: str) -> Column:
    sign = pattern.removeprefix("\\")
    if len(sign) == 1:  # the same number without a regular expression
        return F.coalesce(F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit(""))), F.lit(0))
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))


def add_topic(df: DataFrame, text: str, tokens: str, name: str) -> DataFrame:
    """``df`` with the topic of the whole text; null texts have the other topic."""
    counted = df.select("*", F.array(*[_matches(F.col(text), p) for _, p in TOPICS]).alias("hits"))
    most = F.array_max("hits")
    names = F.array(*[F.lit(t) for t, _ in TOPICS])
    topic = F.when((most > 0) & (most * TOPIC_WORDS >= F.col(tokens)), F.get(names, (F.array_position("hits", most) - 1).cast("int"))).otherwise(F.lit(OTHER_TOPIC))
    return counted.select(*df.columns, topic.alias(name))


def target_shares(names: list[str], tokens: np.ndarray, power: float, given: dict[str, float] | None) -> np.ndarray:
    """Shares of the values ``names``, which have so many tokens: the given ones, or those of the corpus to a power."""
    if given is None:
        share = tokens.astype(float) ** power
    else:
        share = np.array([given.get(n, 0.0) for n in names], float)
        if (share < 0).any() or not np.isfinite(share).all() or share.sum() <= 0:
            raise ValueError("target shares are numbers from 0, one at least above 0 for a value that occurs")
    return share / share.sum()


def rake(cells: dict[str, np.ndarray], tokens: np.ndarray, shares: dict[str, np.ndarray], budget: float, rounds: int, tolerance: float = TOLERANCE) -> np.ndarray:
    """Raked weights of cells; ``cells`` has the value of each dimension as numbers from 0, ``shares`` the targets."""
    tokens = tokens.astype(float)
    total = tokens.sum() * budget
    want = {d: shares[d] * total for d in cells}
    w = tokens * budget
    for _ in range(rounds):
        for d, v in cells.items():
            w = np.minimum(tokens, w * (want[d] / np.maximum(np.bincount(v, w, len(want[d])), 1e-300))[v])
        if all((np.abs(np.bincount(v, w, len(want[d])) - want[d]) <= tolerance * want[d]).all() for d, v in cells.items()):
            break
    return w


def _fit(cells: DataFrame, targets: dict[str, dict[str, float]] | None, exponents: dict[str, float], budget: float, rounds: int, tolerance: float):
    """The cells in order, their weights, and for each dimension the values, their shares and their numbers by cell."""
    n = cells.count()
    if n > MAX_CELLS:
        raise ValueError(f"{n} combinations of source, language and topic; {MAX_CELLS} at most can be raked: group the sources")
    pdf = cells.toPandas().sort_values(list(DIMENSIONS)).reset_index(drop=True)
    if not len(pdf):
        return pdf, np.zeros(0), {}
    tokens, values, numbers = pdf["tokens"].to_numpy(), {}, {}
    for d in DIMENSIONS:
        names, numbers[d] = np.unique(pdf[d].to_numpy(), return_inverse=True)
        values[d] = (names.tolist(), target_shares(names.tolist(), np.bincount(numbers[d], tokens), exponents[d], (targets or {}).get(d)))
    w = rake(numbers, tokens, {d: values[d][1] for d in DIMENSIONS}, budget, rounds, tolerance)
    return pdf, w, {d: (*values[d], numbers[d]) for d in DIMENSIONS}


def draw(id_col: Column, text: Column, seed: str) -> Column:
    """A number in [0, 1) from the id or, where it is null, the text: 52 bits of an MD5 hash."""
    said = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(id_col.cast("string"), text, F.lit(""))))
    return F.conv(F.substring(said, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def _keyed(df: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, topic_col: str | None, seed: str) -> DataFrame:
    """:func:`positional` rows of ``df`` with ``source``, ``lang``, ``topic``, ``tokens`` and the draw ``u``."""
    i, t = F.col(position(df, id_col)), F.col(position(df, text_col))
    name = lambda c: F.coalesce(F.col(position(df, c)).cast("string"), F.lit(""))
    keyed = positional(df).select("*", name(source_col).alias("source"), name(lang_col).alias("lang"), token_count(t).alias("tokens"), draw(i, t, seed).alias("u"))
    return keyed.withColumn("topic", name(topic_col)) if topic_col else add_topic(keyed, position(df, text_col), "tokens", "topic")


def _cells(keyed: DataFrame) -> DataFrame:
    return cut(keyed.where("tokens > 0").groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "cells")


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    *,
    topic_col: str | None = None,
    targets: dict[str, dict[str, float]] | None = None,
    exponents: dict[str, float] = EXPONENTS,
    budget: float = BUDGET,
    rounds: int = ROUNDS,
    tolerance: float = TOLERANCE,
    seed: str = SEED,
    carry: bool = False,
) -> DataFrame:
    """Rows (``id_col``, ``topic``, ``n_tokens``, ``probability``, ``sampled``), one for each row of ``df``.

    ``targets`` gives target shares of values of ``source``, ``lang`` or ``topic``; they are made to sum
    to one over the values that occur, and values left out have none. A dimension without has the
    corpus's shares to the power in ``exponents``. Topics come from ``topic_col`` or, where it is None,
    from the patterns in ``TOPICS``; of equally frequent ones the first wins.

    Tokens are words by white space, of whole texts however long. Null sources, languages and topics
    count as the empty one, null texts as texts without tokens. Texts without tokens weigh nothing: they
    have probability 1 and stay. Repeated ids share one draw, null ids draw by their text. Rows that
    repeat count each. With ``carry`` the rows are the sampled ones of ``df`` with all their columns,
    whatever the names of those. An empty table gives an empty one.
    """
    spark = prepare(df.sparkSession)
    keyed = _keyed(df, id_col, text_col, source_col, lang_col, topic_col, seed)
    if not carry:  # what is told of a row doesn't need its text, so that is read once
        keyed = cut(keyed.select(F.col(position(df, id_col)).alias("id"), *DIMENSIONS, "tokens", "u"), "keyed")
    cells = _cells(keyed)
    pdf, w, _ = _fit(cells, targets, exponents, budget, rounds, tolerance)
    release(cells)
    chances = [(*key, float(p)) for key, p in zip(pdf[list(DIMENSIONS)].itertuples(index=False), w / pdf["tokens"].to_numpy(), strict=True)] if len(pdf) else []
    table = cut(spark.createDataFrame(chances, ", ".join(f"{d} string" for d in DIMENSIONS) + ", p double"), "chances")
    joined = keyed.join(small_or_hashed(table), [keyed[d] == table[d] for d in DIMENSIONS], "left")
    p = F.when(keyed["tokens"] > 0, table["p"]).otherwise(F.lit(1.0))
    if carry:
        return joined.where(keyed["u"] < p).select(*[keyed[c] for c in positional(df).columns]).toDF(*df.columns)
    return joined.select(keyed["id"].alias(id_col), keyed["topic"], keyed["tokens"].alias("n_tokens"), p.alias("probability"), (keyed["u"] < p).alias("sampled"))


def marginals(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    *,
    topic_col: str | None = None,
    targets: dict[str, dict[str, float]] | None = None,
    exponents: dict[str, float] = EXPONENTS,
    budget: float = BUDGET,
    rounds: int = ROUNDS,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """Rows (``dimension``, ``value``, ``tokens``, ``target``, ``expected``) about :func:`mix` with the same arguments.

    For each value that occurs: the tokens there are, those to be sampled by its target, and those
    that the raked weights give; the last two differ where targets can't be met.
    """
    cells = _cells(_keyed(df, id_col, text_col, source_col, lang_col, topic_col, SEED))
    pdf, w, values = _fit(cells, targets, exponents, budget, rounds, tolerance)
    release(cells)
    rows = []
    for d, (names, share, number) in values.items():
        tokens = pdf["tokens"].to_numpy()
        have, got = np.bincount(number, tokens, len(names)), np.bincount(number, w, len(names))
        rows += [(d, n, int(have[i]), float(share[i] * tokens.sum() * budget), float(got[i])) for i, n in enumerate(names)]
    return df.sparkSession.createDataFrame(rows, "dimension string, value string, tokens long, target double, expected double")
