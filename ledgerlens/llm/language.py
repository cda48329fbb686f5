"""Language identification by cross parsing against a suffix automaton for each language.

The reference text of a language is a bounded sample of labelled documents. A text is parsed greedily
into phrases, each the longest run of characters that occurs somewhere in the reference text; the
language whose reference needs the fewest phrases a character wins. Phrases get longer with the logarithm
of the reference's length, so their number is multiplied by it before languages are compared. Where the next character continues
no run, a new phrase begins with it; a character that the reference lacks is a phrase by itself.

Texts are lower-cased, and every run of characters that are neither letters nor marks on letters becomes one
space. Each text is parsed to its end. Many windows of ``WINDOW`` characters are walked in step through the
automaton's moves with numpy, each as if a phrase began with it; then the phrase that is open at a window's end is
carried on into the next window, until it breaks where a phrase of that window begins as well: from there on the two
parses are one. So the phrases are those of one pass over the whole text.

Defined results: a null text and a text without a letter (Unicode's L) get ``und`` and score 0. An empty table gives
an empty one. Ties go to the first
language in alphabetical order. Languages with less than ``LEAST_CHARS`` of reference text aren't compared
if another has as much; the length of the others' references doesn't depend on them. Without labelled text every result is ``und``. Rows that repeat get equal
results. Other columns pass through, and those named as a result give way.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled documents a language that the reference texts are drawn from, at most.
SAMPLE_DOCS = 400
#: Characters of reference text a language.
REFERENCE_CHARS = 24_000
#: A language with fewer characters of reference text is left out: that is less than two stretches.
LEAST_CHARS = 1_000
#: Characters of the longest stretch of one document in a reference text.
STRETCH = 600
WINDOW = 256
UNDETERMINED = "und"

#: States times signs up to which an automaton's moves are one dense table.
DENSE = 1 << 23


def _ranges(found: list[int]) -> str:
    """Code points as the inside of a character class."""
    at = np.array(found)
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    last = np.append(first[1:] - 1, len(at) - 1)
    return "".join(f"\\U{at[a]:08x}-\\U{at[b]:08x}" for a, b in zip(first, last, strict=True))


_MARKS = _ranges([c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == "M"])
_NUMBERS = _ranges([c for c in range(sys.maxunicode + 1) if chr(c).isalnum() and not chr(c).isalpha()])
_OTHER = re.compile(rf"(?:[^\w{_MARKS}]|[_{_NUMBERS}])+")
#: The same for texts below U+0100, which have no marks and few such numbers.
_OTHER_LATIN = re.compile(r"[\W\d_²³¹¼½¾]+")
_LETTER = re.compile(rf"[^\W_{_NUMBERS}{_MARKS}]")


def normalised(text: str | None) -> str:
    """Lower case, with one space for each run of characters that are neither letters nor marks; none without a letter."""
    lower = (text or "").lower()
    try:
        lower.encode("latin-1")
        said = _OTHER_LATIN.sub(" ", lower).strip()
    except UnicodeEncodeError:
        said = _OTHER.sub(" ", lower).strip()
    return said if _LETTER.search(said) else ""


def reference_texts(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, chars: int = REFERENCE_CHARS) -> dict[str, str]:
    """A reference text for each value of ``lang``, at most ``chars`` long, from ``(text, lang)``.

    The sample is the ``sample_docs`` distinct texts of a language with the smallest hashes, so it
    doesn't depend on the order of rows, and copies count once. A hash also says where in its text a
    stretch begins.
    """
    some = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    totals = some.groupBy("lang").count().collect()  # a row a language
    # The smallest hashes of a language lie below a cut-off that leaves eight times the sample, so only
    # that many texts are moved; copies of a text share its hash and go through the cut together.
    if not totals:
        return {}
    parts = F.create_map(*(F.lit(x) for t in totals for x in (t["lang"], min(1.0, 8.0 * sample_docs / t["count"]) * 2.0**32)))
    hashed = some.select("lang", "text", F.xxhash64("text").alias("_h"))
    below = hashed.where(F.pmod("_h", F.lit(1 << 32)) <= F.element_at(parts, F.col("lang")))
    room = F.greatest(F.char_length("text") - 4 * STRETCH, F.lit(0)) + 1
    begin = (F.pmod(F.shiftrightunsigned("_h", 32), room) + 1).cast("int")
    drawn = below.groupBy("lang", "_h").agg(F.min(F.substr("text", begin, F.lit(4 * STRETCH))).alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("_h", F.lit(1 << 32)), "_h"))
    drawn = drawn.withColumn("_k", rank).where(F.col("_k") <= sample_docs)
    pieces: dict[str, list[str]] = {}
    for row in drawn.orderBy("lang", "_k").collect():  # at most languages * sample_docs short texts
        pieces.setdefault(row["lang"], []).append(normalised(row["text"])[:STRETCH])
    joined = {lang: " ".join(x for x in texts if x) for lang, texts in pieces.items()}
    joined = {lang: text for lang, text in joined.items() if text}
    enough = {lang: text for lang, text in joined.items() if len(text) >= min(chars, LEAST_CHARS)}
    return {lang: text[:chars] for lang, text in sorted((enough or joined).items())}


def suffix_automaton(text: str) -> list[dict[str, int]]:
    """The transitions of the automaton that accepts every substring of ``text``; 0 is the start."""
    moves: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return moves


@dataclass(frozen=True)
class _Moves:
    """An automaton's moves by state and sign, dense or, for large alphabets, as sorted keys.

    State 0 stands for "no phrase is open": it moves nowhere, so the next character begins a phrase.
    The automaton's states follow from 1. A missing move is -1.
    """

    column: np.ndarray  # code points to signs; 0 is a character that the reference lacks
    width: int
    keys: np.ndarray | None
    values: np.ndarray

    def __call__(self, state: np.ndarray, sign: np.ndarray) -> np.ndarray:
        at = state.astype(np.int64) * self.width + sign
        if self.keys is None:
            return self.values[at]
        place = np.minimum(np.searchsorted(self.keys, at), len(self.keys) - 1)
        return np.where(self.keys[place] == at, self.values[place], -1).astype(np.int32)


@lru_cache(maxsize=1)
def _tables(references: tuple[tuple[str, str], ...]) -> list[_Moves]:
    """The moves of each language's automaton."""
    tables = []
    for _, text in references:
        alphabet, moves = sorted(set(text)), suffix_automaton(text)
        column = np.zeros(0x110000, np.uint16)
        column[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        at, width = {c: k for k, c in enumerate(alphabet, 1)}, len(alphabet) + 1
        keys = np.array([state * width + at[c] for state, out in enumerate(moves, 1) for c in out], np.int64)
        values = np.array([to + 1 for out in moves for to in out.values()], np.int32)
        if (size := (len(moves) + 1) * width) <= DENSE:
            dense = np.full(size, -1, np.int32)
            dense[keys] = values
            tables.append(_Moves(column, width, None, dense))
        else:
            order = np.argsort(keys)
            tables.append(_Moves(column, width, keys[order], values[order]))
    return tables


def phrase_counts(texts: list[str], references: tuple[tuple[str, str], ...]) -> np.ndarray:
    """Phrases of each normalised text (rows) against each reference (columns)."""
    tables = _tables(references)
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = np.zeros((len(texts), len(tables)), np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(points):
        return counts
    windows = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(texts)), windows)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    begin = np.repeat(np.cumsum(sizes) - sizes, windows) + within * WINDOW
    length = np.minimum(WINDOW, np.repeat(sizes, windows) - within * WINDOW)
    order = np.argsort(-length, kind="stable")
    alive = np.searchsorted(-length[order], -np.arange(WINDOW), side="left")  # windows longer than each step
    ordered = begin[order]
    for k, moves in enumerate(tables):
        flat = moves.column[points]
        fresh = np.maximum(moves(np.ones(moves.width, np.int64), np.arange(moves.width)), 0)  # where a new phrase goes
        starts = np.zeros(len(flat), bool)  # where phrases begin, each window for itself
        state, phrases = np.zeros(len(owner), np.int32), np.zeros(len(owner), np.int64)
        for step in range(int(length[order[0]])):
            n = alive[step]
            at = ordered[:n] + step
            sign = flat[at]
            to = moves(state[:n], sign)
            broken = to < 0
            starts[at] = broken
            phrases[:n] += broken
            state[:n] = np.where(broken, fresh[sign], to)
        last, total = np.empty_like(state), np.empty_like(phrases)
        last[order], total[order] = state, phrases
        total += _carried(np.flatnonzero(within > 0), begin, length, flat, starts, last, moves, fresh)
        counts[:, k] = np.bincount(owner, total, len(texts))
    return counts


def _carried(
    redo: np.ndarray, begin: np.ndarray, length: np.ndarray, flat: np.ndarray, starts: np.ndarray, last: np.ndarray, moves: _Moves, fresh: np.ndarray
) -> np.ndarray:
    """What the phrases of each window change by when the one before it stays open into it.

    ``redo`` are windows with one before them. Where a window's last state changes, the window after it is done again.
    """
    change, follows, own_last = np.zeros(len(begin), np.int64), np.zeros(len(begin) + 1, bool), last.copy()
    follows[redo] = True
    while len(redo):
        now, state, change[redo] = redo, last[redo - 1].copy(), 0
        changed: list[np.ndarray] = []

        def ends(windows: np.ndarray, states: np.ndarray, changed: list[np.ndarray] = changed) -> None:
            differ = last[windows] != states
            last[windows[differ]] = states[differ]
            changed.append(windows[differ] + 1)

        step = 0
        while len(now):
            ended = length[now] <= step
            if ended.any():  # the two parses never met: what is open at the end is the carried phrase
                ends(now[ended], state[ended])
                now, state = now[~ended], state[~ended]
                if not len(now):
                    break
            at = begin[now] + step
            sign = flat[at]
            to = moves(state, sign)
            broken, own = to < 0, starts[at]
            change[now] += broken.astype(np.int64) - own
            going = ~(broken & own)
            ends(now[~going], own_last[now[~going]])
            now, state = now[going], np.where(broken, fresh[sign], to)[going]
            step += 1
        after = np.concatenate(changed) if changed else np.zeros(0, np.int64)
        redo = np.sort(after[follows[after]])
    return change


def identify(docs: DataFrame, references: dict[str, str], text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``phrases`` (a character, of the winner).

    ``score`` compares the two best languages: 0 where they need as many phrases, towards 1 where the
    winner needs far fewer; with one language only it is 1.
    """
    rest = [c for c in docs.columns if c not in ("lang_pred", "score", "phrases")]
    names = [lang for lang, _ in sorted(references.items())]
    pairs = tuple(sorted(references.items()))
    weights = np.log([max(2, len(reference)) for _, reference in pairs])
    result = T.StructType(
        [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("phrases", T.DoubleType())]
    )

    @F.pandas_udf(result)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [normalised(t) for t in batch]
            size = np.array([len(t) for t in texts])
            none = (size == 0) | (not names)
            out = pd.DataFrame({"lang_pred": UNDETERMINED, "score": 0.0, "phrases": 0.0}, index=batch.index)
            if names and not none.all():
                rate = phrase_counts(texts, pairs) / np.maximum(size, 1)[:, None]
                weighed = rate * weights
                best = weighed.argmin(1)
                ordered = np.sort(weighed, 1)
                second = ordered[:, 1] if len(names) > 1 else np.full(len(rate), np.inf)
                out["lang_pred"] = np.where(none, UNDETERMINED, np.array(names, object)[best])
                with np.errstate(invalid="ignore", divide="ignore"):
                    out["score"] = np.where(none, 0.0, np.where(np.isinf(second), 1.0, 1 - ordered[:, 0] / second))
                out["phrases"] = np.where(none, 0.0, rate[np.arange(len(rate)), best])
            yield out

    found = docs.select(*rest, predict(F.col(text)).alias("_r"))
    return found.select(*rest, "_r.lang_pred", "_r.score", "_r.phrases")
