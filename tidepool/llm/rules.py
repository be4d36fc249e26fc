"""Quality rules: a decision list learned by sequential covering.

Text statistics come from one pass over whole texts. Rules that recognise rejected documents are learned
one after the other from labelled statistics: a rule is grown by adding the threshold condition with the
best information gain until it covers no good document of the growing set, pruned from its end on the
other labelled documents, and kept if it is precise there; the documents it covers are then taken out.
The list becomes one ordered Spark conditional expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import annotate, map_texts, raw

_SPACE, _SYMBOLS, _TAIL = b" \t\n\r\x0b\x0c", b"#*$%&|<>", bytes(range(0x80, 0xC0))
_NOT_SYMBOL = bytes(b for b in range(256) if b not in _SYMBOLS)
_NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaim", "n_echo"]
SCHEMA = ", ".join(f"{s} long" for s in STATS)


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that are found twice or more, the first included."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.uint64)
    base = np.uint64(len(number))
    if len(number) < 2_000_000:
        keys = (ids[:-2] * base + ids[1:-1]) * base + ids[2:]
    else:  # the triple would not fit into 64 bits
        pairs = np.unique(ids[:-1] * base + ids[1:], return_inverse=True)[1].astype(np.uint64)
        keys = pairs[:-1] * base + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    hit = order[np.r_[same, False] | np.r_[False, same]]
    for k in range(3):
        twice[hit + k] = True
    return int(twice.sum())


def statistics(text: bytes) -> tuple[int, ...]:
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words), len(text.translate(None, _SPACE + _TAIL)), len(text.translate(None, _NOT_SYMBOL)), len(lines) - len(set(lines)), repeat_words(words),
        len(lines), len(text.translate(None, _NOT_UPPER)), text.count(b"!"), sum(map(bytes.__eq__, words, words[1:])),
    )


def _kernel(part: pa.RecordBatch) -> dict:
    rows = [statistics(t) for t in raw(part, "text")]
    return {s: pa.array([r[i] for r in rows], pa.int64()) for i, s in enumerate(STATS)}


def features(at: str = "") -> dict[str, Column]:
    """What conditions compare with thresholds: shares of the counts, so that length doesn't matter."""
    c = {s: F.col(f"{at}{s}").cast("double") for s in STATS}
    words, chars, lines = (F.greatest(c[x], F.lit(1.0)) for x in ("n_words", "word_chars", "n_lines"))
    return {
        "symbols_per_word": c["n_symbols"] / words, "upper_share": c["n_upper"] / chars, "exclaims_per_word": c["n_exclaim"] / words,
        "repeat_share": c["n_repeat_words"] / words, "echo_share": c["n_echo"] / words, "dup_line_share": c["n_dup_lines"] / lines, "chars_per_word": c["word_chars"] / words,
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self, columns: dict[str, Column]) -> Column:
        return columns[self.feature] > self.threshold if self.above else columns[self.feature] <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int) -> Rule:
    rule: list[Condition] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < most and (inside & ~bad).any():
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        before, best = np.log2(p0 / (p0 + n0)), (1e-9, None)
        for name, values in x.items():
            v, y = values[inside], bad[inside]
            order = np.argsort(v, kind="stable")
            v, y = v[order], y[order]
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not len(cut):
                continue
            low_p, low_n = np.cumsum(y)[cut], np.cumsum(~y)[cut]
            for above, p, n in ((False, low_p, low_n), (True, p0 - low_p, n0 - low_n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / (p + n)) - before), -np.inf)
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (gain[i], Condition(name, above, float((v[cut[i]] + v[cut[i] + 1]) / 2)))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= best[1].holds(x)
    return tuple(rule)


def learn(x: dict[str, np.ndarray], bad: np.ndarray, prune: np.ndarray, precision: float = 0.95, least: int = 3, most_rules: int = 24, most_conditions: int = 4) -> list[Rule]:
    """Sequential covering. prune marks the rows that prune and judge rules and don't grow them."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < most_rules:
        g, h = left & ~prune, left & prune
        if (g & bad).sum() < least:
            break
        rule = _grow({k: v[g] for k, v in x.items()}, bad[g], most_conditions)
        if not rule:
            break
        xh, bh = {k: v[h] for k, v in x.items()}, bad[h]

        def worth(r: Rule) -> tuple[float, int]:
            c = _covers(r, xh, len(bh))
            p, n = int((c & bh).sum()), int((c & ~bh).sum())
            return ((p - n) / (p + n) if p + n else -1.0, -len(r))

        rule = max((rule[:k] for k in range(1, len(rule) + 1)), key=worth)
        covered = _covers(rule, x, len(bad))
        p, n = (covered & left & bad).sum(), (covered & left & ~bad).sum()
        ph, nh = (covered & h & bad).sum(), (covered & h & ~bad).sum()
        if p < least or p < precision * (p + n) or ph < precision * (ph + nh):
            break
        rules.append(rule)
        left &= ~covered
    return rules


def as_column(rules: list[Rule], columns: dict[str, Column]) -> Column:
    """The number of the first rule that holds, from 1; 0 where none does."""
    out = None
    for i, rule in enumerate(rules, 1):
        test = rule[0].column(columns)
        for c in rule[1:]:
            test = test & c.column(columns)
        out = F.when(test, i) if out is None else out.when(test, i)
    return F.lit(0) if out is None else out.otherwise(0)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = 20_000) -> list[Rule]:
    """Learn from at most most_rows labelled documents, those with the smallest hashes of their ids; label 0
    is rejected. Documents that fail the base rule need no other rule and are left out, as are null labels
    and ids; without both labels there are no rules."""
    chosen = (
        labels.select(F.col(f"`{id_col}`").alias("key"), F.col(f"`{label_col}`").cast("int").alias("label")).dropna()
        .orderBy(F.xxhash64("key"), "key").limit(most_rows).groupBy("key").agg(F.min("label").alias("label"))
    )
    own = docs.select(F.col(f"`{id_col}`").alias("key"), F.col(f"`{text_col}`").cast("string").alias("text"))
    own = own.join(F.broadcast(chosen), "key")  # at most most_rows pairs of numbers
    own = own.select(F.struct("key", "label").alias("key"), "text")
    got = map_texts(own, "key", "text", SCHEMA, _kernel).where(~_base_failed())
    rows = got.select("key.label", (F.pmod(F.xxhash64(F.lit(7), F.col("key.key")), F.lit(3)) == 0).alias("prune"), *(v.alias(k) for k, v in features().items())).orderBy("key.key", *features()).toPandas()
    if rows["label"].nunique() < 2:
        return []
    x = {k: rows[k].to_numpy(float) for k in features()}
    return learn(x, rows["label"].to_numpy() == 0, rows["prune"].to_numpy(bool))


def _base_failed(at: str = "") -> Column:
    return (F.col(f"{at}n_words") < 50) | (100 * F.col(f"{at}n_repeat_words") > 50 * F.col(f"{at}n_words"))


def judge(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> tuple[DataFrame, str]:
    """docs with one struct column, whose name comes back: the statistics, base_failed, rule and kept.

    A null or empty text has no words and fails the base rule (fewer than 50 words, or over half of the
    words in repeated 3-word windows); otherwise the first rule that holds rejects, and a document that
    none rejects is kept. Rows are judged one by one, so repeated rows and an empty table need nothing.
    """
    out, name = annotate(docs, text_col, SCHEMA, _kernel)
    at = f"`{name}`."
    base = _base_failed(at)
    rule = as_column(rules, features(at))
    fields = [F.col(f"{at}{s}").alias(s) for s in STATS]
    return out.withColumn(name, F.struct(*fields, base.alias("base_failed"), rule.alias("rule"), (~base & (rule == 0)).alias("kept"))), name
