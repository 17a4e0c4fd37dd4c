"""Search tokens of whole texts in Arrow batches: each distinct word is folded, cut and stemmed once per worker.

The same tokens as text.tokens(), with the exact folding of any script.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from sparkquill.functions.text import ELISION, HYPHENS, SHORTEST_TOKEN, STEM_ENDS, STEM_FROM, STEM_RULES

#: Distinct words that a worker keeps.
KEPT_WORDS = 300_000
#: Counts that leave a worker at once, or those of one text.
LISTED = 200_000

#: \w is letters, numbers of any kind and the underscore, as in text.WORD; marks of decomposed letters belong to their word.
_WORD = re.compile("[\\w\u0300-\u036f]+(?:['’.][\\w\u0300-\u036f]+)*")
_COMPOUND = re.compile(rf"[^\W_]+(?:{HYPHENS}[^\W_]+)+")
_HYPHEN = re.compile(HYPHENS)
_ELISION = re.compile(ELISION, re.DOTALL)
_RULES = [(re.compile(p), to) for p, to in STEM_RULES]


def _is_diacritic(c: str) -> bool:
    return bool(unicodedata.combining(c)) or c in "^`¨¯´·¸" or unicodedata.category(c) == "Mn"


class _Kept(dict):
    """For str.translate: diacritics go, other characters stay; each is looked up once."""

    def __missing__(self, code: int) -> int | None:
        self[code] = None if _is_diacritic(chr(code)) else code
        return self[code]


_KEPT = _Kept()


def fold(text: str) -> str:
    """Decomposed, without diacritics, lower case."""
    if text.isascii():
        return text.replace("^", "").replace("`", "").lower()
    return unicodedata.normalize("NFD", text).translate(_KEPT).lower()


def stem(word: str) -> str:
    if len(word) < STEM_FROM or word[-1] not in STEM_ENDS:  # no rule ends in another letter
        return word
    for pattern, to in _RULES:
        word = pattern.sub(to, word)
    return word


class Analyzer:
    """Tokens of texts; the last text of each field is kept too, as sections of a file repeat it."""

    def __init__(self, kept: int = KEPT_WORDS):
        self.kept, self.known = kept, {}

    def _word(self, raw: str) -> str | None:
        """The token of a word, which a rule may leave empty; None for words that are too short."""
        folded = fold(raw)
        if "'" in folded or "’" in folded:
            folded = _ELISION.sub(r"\2", folded)
        out = stem(folded) if len(folded) >= SHORTEST_TOKEN else None
        if len(self.known) >= self.kept:
            self.known.clear()
        self.known[raw] = out
        return out

    def tokens(self, text: str | None) -> list[str]:
        if not text:
            return []
        known, out = self.known, []
        for raw in _WORD.findall(text):
            t = known[raw] if raw in known else self._word(raw)
            if t is not None:
                out.append(t)
        for found in _COMPOUND.findall(text) if "-" in text or "‐" in text or "‑" in text or "–" in text else ():
            joined = _HYPHEN.sub("", fold(found))
            if len(joined) >= SHORTEST_TOKEN:
                out.append(stem(joined))
        return out


def term_counts(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, n: terms are counted within a row, and over rows of the same key that follow each other in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        analyzer, kind = Analyzer(), None
        last, open_counts = None, None  # the last key's counts wait for its next row
        keys, sizes, terms, counts = [], [], [], []

        def cut() -> pa.RecordBatch:
            repeated = pa.array(keys, kind).take(pa.array([i for i, n in enumerate(sizes) for _ in range(n)], pa.int64()))
            out = pa.RecordBatch.from_arrays([repeated, pa.array(terms, pa.string()), pa.array(counts, pa.int64())], names=[key, "term", "n"])
            for x in (keys, sizes, terms, counts):
                x.clear()
            return out

        def close() -> None:
            keys.append(last)
            sizes.append(len(open_counts))
            terms.extend(open_counts.keys())
            counts.extend(open_counts.values())

        for batch in batches:
            kind = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                for k, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if open_counts is not None and k == last:
                        open_counts.update(analyzer.tokens(x))
                        continue
                    if open_counts is not None:
                        close()
                    last, open_counts = k, Counter(analyzer.tokens(x))
                    if len(terms) >= LISTED:
                        yield cut()
        if open_counts is not None:
            close()
            yield cut()

    return rows.select(key, text).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, term string, n long")


def field_counts(sections: DataFrame, keep: list[str], fields: list[str], only: list[str] | None = None) -> DataFrame:
    """The kept columns, n_<field> (tokens) and counts (term, f_<field>): of the given terms only, if any are given."""
    kinds = [f"{c} {sections.schema[c].dataType.simpleString()}" for c in keep]
    struct = ", ".join(["term: string", *(f"f_{f}: int" for f in fields)])
    wanted = None if only is None else set(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        analyzer = Analyzer()
        last: dict[str, tuple] = {f: (None, Counter(), 0) for f in fields}
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                sizes, columns = {f: [] for f in fields}, {f: [] for f in fields}
                terms, offsets = [], [0]
                for texts in zip(*(part.column(len(keep) + i).to_pylist() for i in range(len(fields))), strict=True):
                    own = []
                    for f, x in zip(fields, texts, strict=True):
                        if x != last[f][0]:
                            found = analyzer.tokens(x)
                            n = len(found)
                            last[f] = (x, Counter(found if wanted is None else [t for t in found if t in wanted]), n)
                        own.append(last[f][1])
                        sizes[f].append(last[f][2])
                    some = dict.fromkeys(t for c in own for t in c)
                    terms += some
                    offsets.append(len(terms))
                    for f, c in zip(fields, own, strict=True):
                        columns[f] += map(c.__getitem__, some)
                counts = pa.StructArray.from_arrays([pa.array(terms, pa.string()), *(pa.array(columns[f], pa.int32()) for f in fields)], names=["term", *(f"f_{f}" for f in fields)])
                arrays = [*part.columns[: len(keep)], *(pa.array(sizes[f], pa.int32()) for f in fields), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), counts)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *(f"n_{f}" for f in fields), "counts"])

    schema = ", ".join([*kinds, *(f"n_{f} int" for f in fields), f"counts array<struct<{struct}>>"])
    return sections.select(*keep, *fields).mapInArrow(run, schema)
