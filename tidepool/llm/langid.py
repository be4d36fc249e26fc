"""Language identification by rank-order profiles.

A profile is the list of the most frequent n-grams (1 to 3 characters, words bounded by a mark), most
frequent first. A document gets the language to whose profile its own has the least out-of-place
distance: the sum over its n-grams of the difference of ranks, or of the profile's length for an n-gram
that the language's profile lacks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import annotate, slices, stored, strings

UNKNOWN, EDGE, LENGTH = "und", np.uint64(1), 300
#: Bytes of text that a step of counting works on: its n-grams take 24 bytes a character, and as much sorted.
STEP_BYTES = 1 << 20
_LETTER: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter, and not a digit or a sign."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER


def grams(text: str) -> np.ndarray:
    """Codes of all 1- to 3-grams of the lower-cased letters, 21 bits a character; a run of other
    characters is one edge mark, and no n-gram is a mark alone."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = letters()[points]
    if not is_letter.any():
        return np.zeros(0, np.uint64)
    c = np.where(is_letter, points, 1).astype(np.uint64)
    c = c[np.r_[True, is_letter[1:] | is_letter[:-1]]]
    c = np.concatenate([[EDGE][: int(c[0] != EDGE)], c, [EDGE][: int(c[-1] != EDGE)]]).astype(np.uint64)
    two = c[:-1] << np.uint64(21) | c[1:]
    return np.concatenate([c[c != EDGE], two, (c[:-2] << np.uint64(42)) | two[1:]])


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.sort(codes)
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.diff(np.r_[first, len(codes)])


def ranked(codes: np.ndarray, counts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The most frequent codes; of equally frequent ones the smaller first."""
    if len(counts) > length:
        least = np.partition(counts, len(counts) - length)[len(counts) - length]
        keep = counts >= least
        codes, counts = codes[keep], counts[keep]
    return codes[np.argsort(-counts, kind="stable")][:length]


class Profiles:
    def __init__(self, ranks: dict[str, list[int]], length: int = LENGTH):
        self.languages, self.length = sorted(ranks), length
        self.codes = np.unique(np.array([c for p in ranks.values() for c in p], np.uint64))
        self.places = np.full((len(self.codes) + 1, len(ranks)), length, np.int64)
        for i, name in enumerate(self.languages):
            self.places[np.searchsorted(self.codes, np.array(ranks[name], np.uint64)), i] = np.arange(len(ranks[name]))

    def distances(self, profile: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.codes, profile)
        known = self.codes[np.minimum(at, len(self.codes) - 1)] == profile if len(self.codes) else np.zeros(len(profile), bool)
        places = self.places[np.where(known, at, len(self.codes))]
        d = np.abs(places - np.arange(len(profile))[:, None])
        return np.where(places == self.length, self.length, d).sum(axis=0)

    def predict(self, text: str) -> tuple[str, float]:
        """The language (of equally near ones the first by name) and a score: 1 minus the nearest
        distance's share in the two nearest; the unknown language has 0."""
        profile = ranked(*counted(grams(text)), self.length)
        if not len(profile) or not self.languages:
            return UNKNOWN, 0.0
        d = self.distances(profile)
        best = int(np.argmin(d))
        rival = float(np.min(np.delete(d, best))) if len(d) > 1 else float(self.length * len(profile))
        return self.languages[best], 1.0 - float(d[best]) / (d[best] + rival) if d[best] + rival else 0.5


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", length: int = LENGTH, flush: int = 2_000_000) -> Profiles:
    """Profiles of all rows with a text and a language. n-grams are counted in each task (at most `flush`
    at a time), the counts summed by Spark, and each language's first `length` taken, of equally frequent
    ones by code. Rows with a null text or language and texts without letters add nothing; repeated rows
    count each; without any row there are no profiles, and every text is `und`."""
    narrow = docs.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text")).dropna()

    def rows(found: dict[str, tuple[np.ndarray, np.ndarray]]):
        for lang, (codes, n) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "code", "n"])

    def run(batches):
        found: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for part in slices(batch, "text", STEP_BYTES):
                by: dict[str, list[str]] = {}
                for lang, text in zip(part.column("lang").to_pylist(), strings(part, "text")):
                    by.setdefault(lang, []).append(text)
                for lang, texts in by.items():
                    codes, n = counted(np.concatenate([grams(t) for t in texts]))
                    if lang in found:
                        old_codes, old_n = found[lang]
                        codes, at = np.unique(np.concatenate([old_codes, codes]), return_inverse=True)
                        n = np.bincount(at, weights=np.concatenate([old_n, n])).astype(np.int64)
                    found[lang] = codes, n
                if sum(len(c) for c, _ in found.values()) > flush:
                    yield from rows(found)
                    found = {}
        yield from rows(found)

    counts = stored(narrow.mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")), "ngrams")
    # Languages are a handful of names, each with `length` n-grams.
    names = [r["lang"] for r in counts.select("lang").distinct().collect()]
    ranks = {name: [r["code"] for r in counts.where(F.col("lang") == name).orderBy(F.desc("n"), "code").limit(length).collect()] for name in names}
    return Profiles({k: v for k, v in ranks.items() if v}, length)


def identify(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> tuple[DataFrame, str]:
    """docs with one struct column (lang_pred, score), whose name comes back. A text that is null, empty or
    without letters is `und` with score 0; of equally near languages it is the first by name, with score 0.5;
    nothing but the text is read, rows are judged one by one, and an empty table stays one."""

    def kernel(part: pa.RecordBatch) -> dict:
        got = [profiles.predict(t) for t in strings(part, "text")]
        return {"lang_pred": pa.array([x for x, _ in got], pa.string()), "score": pa.array([y for _, y in got], pa.float64())}

    return annotate(docs, text_col, "lang_pred string, score double", kernel)
