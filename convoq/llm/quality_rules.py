"""Quality rules: a decision list learned by sequential covering, run as Spark conditional expressions.

Every whole text gets a few interpretable statistics. From labelled rows, rules are grown one after
the other, each a conjunction of thresholds (`upper_share > 0.31 and n_words > 12`) for low quality:
terms are added by information gain on two thirds of the rows not yet covered, and dropped from the
end while that helps on the other third. A rule that is not precise there is not taken. The list
becomes one ordered CASE WHEN over the statistics; what no rule covers is kept.

The fit looks at no more than FIT_ROWS labelled rows (those with the smallest hashes), numbers only, and
makes at most MAX_RULES rules of at most MAX_TERMS terms; the statistics and the verdicts cover all rows.

Defined cases: null and empty texts have no words, zero statistics and fail the base rules; labels
that are null or for no document are ignored, of several for a document the lowest counts; without
labels of both kinds the list is empty and the base rules decide alone. Of a very long text all words
are counted; a worker holds the text, its words and their windows. Repeated rows are judged alike;
extra columns pass through, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from functools import reduce
from operator import and_, eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convoq.llm.common import bounded, fresh, quoted, with_column, written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3
SYMBOLS = b"#*$%&|<>"
FIT_ROWS = 20_000
#: A rule needs this share of low-quality rows among those it covers in the pruning rows, and so many of them.
PRECISION, LEAST_ROWS, MAX_RULES, MAX_TERMS = 0.95, 3, 24, 4
CUTS = 64

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHARES = ("symbols_per_word", "upper_share", "punct_per_word", "repeat_share", "dup_line_share", "mean_word", "digit_share", "same_next_share")
STATS = T.StructType([*[T.StructField(c, T.LongType()) for c in COUNTS], *[T.StructField(c, T.DoubleType()) for c in SHARES]])
_DROP_SYMBOLS = re.compile(b"[^" + re.escape(SYMBOLS) + b"]+")
_UPPER, _LOWER, _DIGIT, _PUNCT = (bytes(sorted(x)) for x in (range(65, 91), range(97, 123), range(48, 58), b"!?.,;:\"'()[]{}/\\_-+=~^@`"))


def _count(text: bytes, which: bytes) -> int:
    return len(text) - len(text.translate(None, which))


def repeated_words(words: list[bytes]) -> int:
    """How many words stand in a window of WINDOW words that occurs twice or more in the text."""
    grams = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
    seen = Counter(grams)
    if len(seen) == len(grams):
        return 0
    at = np.fromiter((seen[g] > 1 for g in grams), bool, len(grams))
    covered = np.zeros(len(words), bool)
    for i in range(WINDOW):
        covered[i : i + len(at)] |= at
    return int(covered.sum())


def duplicate_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier one."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines), len(lines) - len(set(lines))


def statistics(text: bytes | None) -> tuple:
    text = text or b""
    words = text.split()
    n, solid = len(words), b"".join(words)
    chars = len(solid) - sum(map(len, re.findall(rb"[\x80-\xbf]+", solid))) if not solid.isascii() else len(solid)
    symbols, repeat = _count(text, SYMBOLS), repeated_words(words)
    lines, dup = duplicate_lines(text)
    upper = _count(solid, _UPPER)
    letters = upper + _count(solid, _LOWER)
    ratio = lambda a, b: a / b if b else 0.0
    return (
        n, chars, symbols, dup, repeat,
        ratio(symbols, n), ratio(upper, letters), ratio(_count(solid, _PUNCT), n), ratio(repeat, n), ratio(dup, lines), ratio(chars, n),
        ratio(_count(solid, _DIGIT), chars), ratio(sum(map(eq, words[1:], words[:-1])), n),
    )


def with_statistics(df: DataFrame, text: str = "text", name: str = "stats") -> DataFrame:
    """df with a struct column of STATS."""
    kind = pa.struct([(c, pa.int64()) for c in COUNTS] + [(c, pa.float64()) for c in SHARES])

    def of(texts: list[bytes | None]) -> pa.Array:
        rows = [statistics(t) for t in texts]
        cols = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(kind), kind, strict=True)]
        return pa.StructArray.from_arrays(cols, fields=list(kind))

    return with_column(df, text, lambda: of, STATS, name)


def base_failed(s: Callable[[str], Column]) -> Column:
    return (s("n_words") < MIN_WORDS) | (100 * s("n_repeat_words") > MAX_REPEAT_PERCENT * s("n_words"))


class DecisionList:
    """Ordered rules; each is a list of (statistic, '>' or '<=', threshold) that marks low quality."""

    def __init__(self, rules: list[list[tuple[str, str, float]]]):
        self.rules = rules

    def __str__(self) -> str:
        return "\n".join("drop if " + " and ".join(f"{c} {op} {x:.6g}" for c, op, x in r) for r in self.rules) or "keep all"

    def keeps(self, s: Callable[[str], Column]) -> Column:
        """The list as one CASE WHEN: false for the first rule that holds, else true."""
        case = F
        for rule in self.rules:
            case = case.when(reduce(and_, [(s(c) > x) if op == ">" else (s(c) <= x) for c, op, x in rule]), F.lit(False))
        return case.otherwise(F.lit(True)) if self.rules else F.lit(True)


def _covers(rule: list[tuple[int, str, float]], x: np.ndarray) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for c, op, t in rule:
        hit &= (x[:, c] > t) if op == ">" else (x[:, c] <= t)
    return hit


def _grow(x: np.ndarray, low: np.ndarray) -> list[tuple[int, str, float]]:
    """Adds the term of the largest information gain until only low rows are covered."""
    rule: list[tuple[int, str, float]] = []
    hit = np.ones(len(x), bool)
    while len(rule) < MAX_TERMS and low[hit].any() and not low[hit].all():
        p, n = low[hit].sum(), (~low[hit]).sum()
        best, term = 0.0, None
        for c in range(x.shape[1]):
            values = np.unique(x[hit, c])
            cuts = values[:-1] + np.diff(values) / 2
            if len(cuts) > CUTS:
                cuts = np.unique(np.quantile(x[hit & low, c], np.linspace(0, 1, CUTS // 2)).tolist() + np.quantile(x[hit & ~low, c], np.linspace(0, 1, CUTS // 2)).tolist())
            for op in (">", "<="):
                for t in cuts:
                    now = hit & ((x[:, c] > t) if op == ">" else (x[:, c] <= t))
                    p1, n1 = low[now].sum(), (~low[now]).sum()
                    if p1 and (gain := p1 * (np.log2(p1 / (p1 + n1)) - np.log2(p / (p + n)))) > best + 1e-9:
                        best, term = gain, (c, op, float(t))
        if term is None:
            break
        rule.append(_centred(term, x[hit], low[hit]))
        hit = _covers(rule, x)
    return rule


def _centred(term: tuple[int, str, float], x: np.ndarray, low: np.ndarray) -> tuple[int, str, float]:
    """The term with its threshold halfway between the low rows that it covers and the others that it doesn't."""
    c, op, t = term
    over = x[:, c] > t
    inner, outer = (x[over & low, c], x[~over & ~low, c]) if op == ">" else (x[~over & low, c], x[over & ~low, c])
    if not len(inner) or not len(outer):
        return term
    a, b = (inner.min(), outer.max()) if op == ">" else (inner.max(), outer.min())
    return c, op, float((a + b) / 2)


def learn(x: np.ndarray, low: np.ndarray, names: tuple[str, ...], order: np.ndarray) -> DecisionList:
    """Sequential covering: x has a row of statistics, low marks low quality, order splits rows for growing and pruning."""
    rules: list[list[tuple[str, str, float]]] = []
    rest = np.ones(len(x), bool)
    prune = order % 3 == 0
    while len(rules) < MAX_RULES:  # an attempt that gives no rule takes rows away, so the attempts end, too
        if not (low & rest & ~prune).any():
            break
        rule = _grow(x[rest & ~prune], low[rest & ~prune])

        def worth(r: list, held: np.ndarray = rest & prune) -> float:
            hit = _covers(r, x) & held
            return (low[hit].sum() - (~low[hit]).sum()) / max(1, hit.sum()) if r else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        hit = _covers(rule, x) & rest
        held = hit & prune
        if not rule or not hit.any():
            break
        if low[held].sum() < LEAST_ROWS or low[held].mean() < PRECISION or low[hit].mean() < PRECISION:
            rest &= ~(hit & low & ~prune)  # not precise enough: look for rules for other low rows
            continue
        rules.append([(names[c], op, t) for c, op, t in rule])
        rest &= ~hit
    return DecisionList(rules)


def sampled(labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, quality) of at most `rows` labelled documents: those with the smallest hashes."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return written(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows), "labels")


def fit(stats: DataFrame, known: DataFrame, rows: int = FIT_ROWS) -> DecisionList:
    """Learns from the rows of stats (doc_id, stats) that `known` labels; repeated rows beyond `rows` are left out."""
    names = SHARES
    some = stats.join(bounded(known), "doc_id").where("stats.n_words > 0")
    some = some.select("quality", F.xxhash64("doc_id").alias("h"), *[F.col(f"stats.{c}").cast("double").alias(c) for c in names])
    got = np.array([tuple(r) for r in some.orderBy("h", *names).limit(rows).collect()], float).reshape(-1, len(names) + 2)
    return learn(got[:, 2:], got[:, 0] == 0, names, np.arange(len(got)))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, the counts, base_failed, kept) for every row."""
    stats = written(with_statistics(docs.select("doc_id", F.col("text").cast("string").alias("text"))).drop("text"), "statistics")
    rules = fit(stats, sampled(labels))
    s = lambda c: F.col(f"stats.{c}")
    failed = base_failed(s)
    return stats.select("doc_id", *[s(c).alias(c) for c in COUNTS], failed.alias("base_failed"), (~failed & rules.keeps(s)).alias("kept"))


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the base rules and the learned list keep, all columns as they are."""
    known = sampled(labels)
    seen = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(bounded(known), "doc_id", "left_semi")
    rules = fit(written(with_statistics(seen).drop("text"), "statistics"), known)
    name = fresh(docs.columns, "stats")
    s = lambda c: F.col(f"{name}.{c}")
    return with_statistics(docs, name=name).where(~base_failed(s) & rules.keeps(s)).select(*[quoted(c) for c in docs.columns])
