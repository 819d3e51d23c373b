"""Data rules as counters: many rules cost one pass, and none where the rows are written anyway.

A `Rule` says by a condition which rows break it. `watched` attaches the counters of a list of
rules to a frame (`DataFrame.observe`); whatever action consumes the frame fills them in. Only
where a counter is not zero are rows looked at again, for the examples in the error. `check`
counts the rules of a frame at rest in one aggregation, unique keys included.

Counters belong behind the last shuffle of a write, as `watched_by_key` lays them: a task that
runs again for a lost executor then counts its rows once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from monthloom.operators.checks import KEY, DataCheckError, any_of, duplicate_keys, require_none
from monthloom.functions.numeric import is_finite

_COPY, _ROWS = "_copy", "_rows"


@dataclass(frozen=True)
class Rule:
    """`violated` is true for a row that breaks the rule; `find` gives rows for the error."""

    name: str
    message: str
    violated: Column
    shown: tuple[str, ...] = KEY
    find: Callable[[DataFrame], DataFrame] | None = None

    def rows(self, df: DataFrame) -> DataFrame:
        return df.filter(self.violated).select(*self.shown) if self.find is None else self.find(df)


def finite(name: str, message: str, columns: Sequence[str], shown: Sequence[str] = KEY) -> Rule:
    """The columns are neither missing nor NaN nor infinite."""
    tests = [~is_finite(F.col(f"`{c}`")) for c in columns] or [F.lit(False)]
    return Rule(name, message, any_of(tests), tuple(shown))


def unique(message: str, key: Sequence[str] = KEY) -> Rule:
    """The key occurs once; rows carry their number within the key, as `numbered` adds it."""
    return Rule("repeated_key", message, F.col(_COPY) > 1, tuple(key), lambda df: duplicate_keys(df, key))


def numbered(df: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Rows with their number within the key. On a frame laid out by ranges or hashes of the
    key this is a sort within the partitions, no shuffle."""
    return df.withColumn(_COPY, F.row_number().over(Window.partitionBy(*key).orderBy(key[0])))


@dataclass
class Watched:
    """A frame that counts its rules as it is consumed. `counts` waits for the first action."""

    frame: DataFrame
    rules: tuple[Rule, ...]
    seen: Observation = field(repr=False)

    @property
    def counts(self) -> dict:
        return self.seen.get

    def require(self, rows: DataFrame) -> dict:
        """Raise for the first broken rule, with examples from `rows`, the frame as written."""
        for rule in self.rules:
            if self.counts[rule.name]:
                require_none(rule.rows(rows), rule.message)
                raise DataCheckError(f"{rule.message} Rows: {self.counts[rule.name]}.")
        return self.counts


def _counters(rules: Sequence[Rule], totals: dict[str, Column]) -> list[Column]:
    counted = [F.count_if(rule.violated).alias(rule.name) for rule in rules]
    return [F.count(F.lit(1)).alias(_ROWS), *counted, *(c.alias(n) for n, c in totals.items())]


def watched(df: DataFrame, rules: Sequence[Rule], totals: dict[str, Column] | None = None) -> Watched:
    """`df` with the counters of the rules, and any further `totals`, on it."""
    seen = Observation()
    return Watched(df.observe(seen, *_counters(rules, totals or {})), tuple(rules), seen)


def watched_by_key(
    df: DataFrame, rules: Sequence[Rule], totals: dict[str, Column] | None = None, key: Sequence[str] = KEY
) -> Watched:
    """The same for rows laid out by ranges of their key, sorted by it, with the key unique
    among the rules. The layout's shuffle is the only one."""
    laid = numbered(df.repartitionByRange(*key), key)
    found = watched(laid, rules, totals)
    # the window has sorted by the key already
    return Watched(found.frame.drop(_COPY).sortWithinPartitions(*key), found.rules, found.seen)


def counted(
    df: DataFrame, rules: Sequence[Rule], totals: dict[str, Column] | None = None, key: Sequence[str] = KEY
) -> DataFrame:
    """One row: the rows, the violations of each rule, and the totals. A rule on repeated keys
    is counted by a map-side aggregation over the key, and totals are then over distinct keys."""
    totals = totals or {}
    plain = [r for r in rules if r.name != "repeated_key"]
    if len(plain) == len(rules):
        return df.agg(*_counters(rules, totals))
    per_key = df.groupBy(*key).agg(*_counters(plain, {}))
    again = F.coalesce(F.sum(F.col(_ROWS) - 1), F.lit(0)).alias("repeated_key")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (_ROWS, *(r.name for r in plain))]
    return per_key.agg(*sums, again, *(c.alias(n) for n, c in totals.items()))


def violations(df: DataFrame, rules: Sequence[Rule], key: Sequence[str] = KEY) -> DataFrame:
    """(rule, n_rows) of all rules, broken or not, in one pass."""
    names = [r.name for r in rules]
    pairs = F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("n_rows")) for n in names))
    return counted(df, rules, key=key).select(F.inline(pairs))


def check(
    df: DataFrame, rules: Sequence[Rule], totals: dict[str, Column] | None = None, key: Sequence[str] = KEY
) -> dict:
    """Raise for the first broken rule of a frame at rest; one job if none is broken."""
    found = counted(df, rules, totals, key).first().asDict()
    for rule in rules:
        if found[rule.name]:
            require_none(rule.rows(df), rule.message)
    return found
