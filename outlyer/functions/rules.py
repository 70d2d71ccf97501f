"""The rule language: strings such as ``age < 30 & ~(sex = F)`` as Spark columns.

Operators, loosest first: ``|``, ``&``, ``~``, and ``= < <= > >=``; parentheses; ``[w]`` after a
rule gives it a weight. Names are columns, other bare words and quoted ones are strings. A rule is
rewritten into a SQL expression and left to Spark's parser, so comparisons reach the scan as filters.
Two-valued logic: a comparison with null is an error in the language, here it is false.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(<=|>=|[=<>&|~()\[\]])|('[^']*'|\"[^\"]*\")|(-?\d+\.?\d*(?:[eE][-+]?\d+)?)|([A-Za-z_][\w.]*))")
_WORDS = {"&": "AND", "|": "OR", "~": "NOT"}
_COMPARE = ("=", "<", "<=", ">", ">=")


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at, text = [], 0, text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"cannot read the rule at: {text[at:]!r}")
        kind = ("op", "text", "number", "name")[m.lastindex - 1]
        out.append((kind, m[m.lastindex]))
        at = m.end()
    return out


def to_sql(rule: str, columns: list[str]) -> str:
    """The rule as a SQL condition over ``columns``; it raises ValueError for unknown names."""
    parts, tokens, k = [], _tokens(rule), 0
    if not tokens:
        raise ValueError("an empty rule")
    while k < len(tokens):
        kind, value = tokens[k]
        if k + 2 < len(tokens) and tokens[k + 1][1] in _COMPARE:
            (left, op), (right_kind, right) = (tokens[k], tokens[k + 1][1]), tokens[k + 2]
            if left[0] != "name" or left[1] not in columns:
                raise ValueError(f"unknown variable {left[1]}")
            if right_kind == "op" or (right_kind == "name" and right in columns):
                raise ValueError(f"{left[1]} must be compared with a constant")
            value = right if right_kind == "number" else "'" + right.strip("'\"").replace("'", "''") + "'"
            parts.append(f"coalesce(`{left[1]}` {op} {value}, false)")
            k += 3
        elif value == "[":
            if k + 2 >= len(tokens) or tokens[k + 2][1] != "]" or tokens[k + 1][0] != "number":
                raise ValueError("invalid weight")
            k += 3
        elif kind == "op" and value not in _COMPARE and value != "]":
            parts.append(_WORDS.get(value, value))
            k += 1
        else:
            raise ValueError(f"unexpected {value}")
    return " ".join(parts)


def weight_of(rule: str) -> float:
    """The weight after a rule, 1 without one."""
    m = re.search(r"\[\s*(-?[\d.]+)\s*\]\s*$", rule)
    return float(m[1]) if m else 1.0


def condition(rule: str, rows: DataFrame) -> Column:
    return F.expr(to_sql(rule, rows.columns))


@dataclass(frozen=True)
class ConjunctiveRule:
    """Comparisons joined by ``&``: ``(feature, op, value)``."""

    parts: tuple[tuple[str, str, str], ...]
    id: int = 0
    stats: dict = field(default_factory=dict, compare=False)

    @classmethod
    def parse(cls, text: str, id: int = 0) -> ConjunctiveRule:
        tokens = [t for t in _tokens(re.sub(r"\[[^\]]*\]\s*$", "", text)) if t[1] not in ("(", ")")]
        if any(t[1] in ("|", "~") for t in tokens) or len(tokens) % 4 != 3:
            raise ValueError(f"not a conjunction: {text}")
        for k in range(3, len(tokens), 4):
            if tokens[k][1] != "&":
                raise ValueError(f"not a conjunction: {text}")
        return cls(tuple((tokens[k][1], tokens[k + 1][1], tokens[k + 2][1]) for k in range(0, len(tokens), 4)), id)

    def __str__(self) -> str:
        return " & ".join(f"{f} {op} {v}" for f, op, v in self.parts)

    def __len__(self) -> int:
        return len(self.parts)

    def ground(self, row: dict) -> str:
        """The rule with a row's own values in place of its features."""
        return " & ".join(f"{f}({row[f]}) {op} {v}" for f, op, v in self.parts)

    def column(self, rows: DataFrame) -> Column:
        return condition(str(self), rows)

    def ranges(self) -> dict[str, tuple[float, float]]:
        """Bounds of each continuous feature, strictness lost."""
        out: dict[str, tuple[float, float]] = {}
        for f, op, v in self.parts:
            lo, hi = out.get(f, (float("-inf"), float("inf")))
            value = float(v)
            out[f] = (max(lo, value) if op in (">", ">=", "=") else lo, min(hi, value) if op in ("<", "<=", "=") else hi)
        return out


def rule_of_ranges(ranges: dict[str, tuple[float, float]]) -> str | None:
    """``f > lo & f <= hi`` with six decimals; None when nothing is bounded."""
    parts = []
    for f, (lo, hi) in sorted(ranges.items()):
        parts += [f"{f} > {lo:.6f}"] * (lo != float("-inf")) + [f"{f} <= {hi:.6f}"] * (hi != float("inf"))
    return " & ".join(parts) or None


def satisfying(rows: DataFrame, rule: str, id_col: str = "id") -> DataFrame:
    return rows.where(condition(rule, rows)).select(id_col)


def satisfaction(rows: DataFrame, rules: list[str], id_col: str = "id") -> DataFrame:
    """``id, rule_id, covered``: a row for each row and rule."""
    flags = F.array(*(F.struct(F.lit(k).alias("rule_id"), condition(r, rows).cast("int").alias("covered")) for k, r in enumerate(rules)))
    return rows.select(id_col, F.explode(flags).alias("f")).select(id_col, "f.*")


def any_satisfied(rows: DataFrame, rules: list[str]) -> DataFrame:
    """``rows`` with ``covered``: 1 where at least one rule holds."""
    return rows.withColumn("covered", reduce(lambda a, b: a | b, (condition(r, rows) for r in rules)).cast("int"))


def confusion(rows: DataFrame, rules: list[str], y_col: str = "y") -> DataFrame:
    """``rule_id, tp, fp, fn, tn, support`` of each rule, from one pass."""
    y = F.col(y_col) == 1
    aggs = []
    for k, r in enumerate(rules):
        c = condition(r, rows)
        aggs += [F.count_if(a).alias(f"{n}{k}") for n, a in (("tp", c & y), ("fp", c & ~y), ("fn", ~c & y), ("tn", ~c & ~y))]
    one = rows.agg(*aggs)
    out = F.array(*(F.struct(F.lit(k).alias("rule_id"), *(F.col(f"{n}{k}").alias(n) for n in ("tp", "fp", "fn", "tn"))) for k in range(len(rules))))
    seen = F.col("tp") + F.col("fp")
    return one.select(F.explode(out).alias("r")).select("r.*").withColumn("support", F.when(seen > 0, F.col("tp") / seen))


def ruleset_scores(rows: DataFrame, rules: list[str], y_col: str = "y") -> DataFrame:
    """``precision, recall, f1`` of the rules' union, and ``f1_weighted`` over both classes."""
    c, y = F.col("covered") == 1, F.col(y_col) == 1
    n = any_satisfied(rows, rules).agg(*(F.count_if(a).cast("double").alias(k) for k, a in (("tp", c & y), ("fp", c & ~y), ("fn", ~c & y), ("tn", ~c & ~y))))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    f1, f0 = ratio(2 * tp, 2 * tp + fp + fn), ratio(2 * tn, 2 * tn + fp + fn)
    return n.select(
        ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), f1.alias("f1"),
        ratio((tp + fn) * f1 + (tn + fp) * f0, tp + fp + fn + tn).alias("f1_weighted"),
    )


def factor_levels(rows: DataFrame, col: str) -> DataFrame:
    """``level, code``: the sorted distinct levels, coded from 0. As many rows as levels."""
    from outlyer.functions.ranking import row_numbers

    return row_numbers(rows.where(F.col(col).isNotNull()).select(F.col(col).alias("level")).distinct(), ["level"], "code")


def one_hot(rows: DataFrame, col: str) -> DataFrame:
    """``rows`` with ``code`` and ``hot``; a null level has neither."""
    levels = factor_levels(rows, col)
    n = levels.agg(F.count(F.lit(1)).alias("__n"))
    coded = rows.join(levels.withColumnRenamed("level", col), col, "left").crossJoin(F.broadcast(n))
    hot = F.transform(F.sequence(F.lit(0), (F.col("__n") - 1).cast("int")), lambda i: (i == F.col("code")).cast("int"))
    return coded.withColumn("hot", F.when(F.col("code").isNotNull(), hot)).drop("__n")
