"""License scans: winnowed fingerprints of templates pick candidates, banded alignment reports coverage and spans.

Templates are cut into runs of ``GRAM`` words, winnowed (the smallest hash of each window of ``WINDOW`` runs stays)
and kept in an inverted index from fingerprint to template and place; templates of up to ``SHORT`` words keep all runs.
Every run of a document is looked up; hits of a template on neighbouring diagonals form a candidate, and any stretch of
a template of GRAM + WINDOW - 1 words that a text holds unchanged makes one.  A candidate whose stretch of text has
enough in common with the template, by the length of their longest common subsequence, is aligned with it inside a band
around its diagonal; the matched words give the coverage, and the first and last of them the span.

Hits outside the matches of their template are chained in text order, whatever stands or is missing between them, and
the text around a chain is aligned with the whole template: this finds templates that a long insertion or omission has
split.  Of an insertion only the parts next to the chain's hits are aligned.

A match is reported from ``min_coverage`` up, unless its span lies inside that of a match of more words; text inserted
into a split match is not inside it.

The index is made from the templates alone, checked against ``MAX_INDEX`` and shipped to the tasks; documents are
scanned whole and in place, without a shuffle.  Words are runs of letters, digits and bytes outside ASCII, with A-Z
lower-cased.  Defined results: null and empty texts have no matches; repeated rows have repeated matches; templates
without words are ignored; equal alignments keep the later start.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.llm._common import bounded_batches, pieces, quoted

GRAM = 3
WINDOW = 3
SHORT = 32
MAX_INDEX = 5_000_000
MAX_WORDS_KEPT = 150_000
#: A-Z to a-z, other ASCII but letters and digits to spaces; bytes of other characters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def fold(text: str) -> bytes:
    return text.encode("utf-8").translate(_FOLD)


def winnow(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the smallest hash (the last of equals) of each window."""
    n = len(hashes)
    if n <= window:
        return np.array([n - 1 - int(np.argmin(hashes[::-1]))]) if n else np.array([], np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)
    return np.unique(np.arange(len(views)) + window - 1 - np.argmin(views[:, ::-1], axis=1))


def align(template: list[int], text: np.ndarray, diagonal: int, band: int) -> tuple[int, int, int]:
    """Most template words matched in order near a diagonal, and the first and last place in the text of those words."""
    low, wide = diagonal - band, 2 * band + 1
    n = len(text)
    score, first, last = [0] * (wide + 1), [-1] * (wide + 1), [-1] * (wide + 1)
    for i, word in enumerate(template):
        # cell k of row i stands for the text up to place i + low + k; the row before has that place at k + 1
        new_score, new_first, new_last = [0] * (wide + 1), [-1] * (wide + 1), [-1] * (wide + 1)
        for k in range(wide):
            j = i + low + k
            s, f, e = score[k + 1], first[k + 1], last[k + 1]
            if k and (new_score[k - 1], new_first[k - 1]) > (s, f):
                s, f, e = new_score[k - 1], new_first[k - 1], new_last[k - 1]
            if 0 <= j < n and text[j] == word:
                m = (score[k] + 1, first[k] if first[k] >= 0 else j)
                if m > (s, f):
                    (s, f), e = m, j
            new_score[k], new_first[k], new_last[k] = s, f, e
        new_score[wide] = -1
        score, first, last = new_score, new_first, new_last
    best = max(range(wide), key=lambda k: (score[k], first[k]))
    return score[best], first[best], last[best]


@dataclass
class LicenseIndex:
    names: list[str]
    templates: list[list[int]]
    prints: np.ndarray  # sorted fingerprints
    owners: np.ndarray  # (template, place) of each

    @classmethod
    def build(cls, templates: list[tuple[str, str]]) -> LicenseIndex:
        names, words, rows = [], [], []
        for name, text in templates:
            own = [xxhash.xxh3_64_intdigest(w) for w in fold(text).split()]
            if not own:
                continue
            grams = _grams(np.array(own, np.uint64))
            rows += [(int(grams[p]), len(names), int(p)) for p in (range(len(grams)) if len(own) <= SHORT else winnow(grams))]
            names.append(name)
            words.append(own)
        if len(rows) > MAX_INDEX:
            raise ValueError(f"the index has over {MAX_INDEX} fingerprints")
        rows.sort()
        return cls(names, words, np.array([r[0] for r in rows], np.uint64), np.array([r[1:] for r in rows], np.int64).reshape(-1, 2))

    def scan(self, words: np.ndarray, min_coverage: float) -> list[tuple[int, int, int, int]]:
        """Matches in a text's word hashes: (template, matched words, first and last word of the text)."""
        grams = _grams(words)
        left, right = np.searchsorted(self.prints, grams, "left"), np.searchsorted(self.prints, grams, "right")
        hit = np.flatnonzero(right > left)
        if not len(hit):
            return []
        by: dict[int, list[tuple[int, int]]] = {}
        for p in hit.tolist():
            for t, place in self.owners[left[p] : right[p]].tolist():
                by.setdefault(t, []).append((p, place))
        found, split = [], []
        for t, hits in by.items():
            template = self.templates[t]
            band = _band(template)
            diagonals = sorted(p - place for p, place in hits)
            begin = previous = diagonals[0]
            whole = []
            for d in [*diagonals[1:], None]:
                if d is not None and d - begin <= band:
                    previous = d
                    continue
                middle = (begin + previous) // 2
                near = words[max(0, middle - band) : max(0, middle + band + len(template))].tolist()
                # what the whole stretch has in common bounds what a band of it can have
                if near and full_length(template, near)[-1] >= min_coverage * len(template):
                    matched, first, last = align(template, words, middle, band)
                    if matched >= min_coverage * len(template):
                        whole.append((t, matched, first, last))
                if d is not None:
                    begin = previous = d
            found += whole
            split += [(t, *m) for m in split_matches(template, words, _outside(hits, whole), min_coverage)]
        out = _outermost(found)
        kept = []
        for i, m in enumerate(split):
            others = [(x[0], x[1], x[2], x[3]) for x in out] + [(x[0], x[1], a, b) for k, x in enumerate(split) if k != i for a, b in x[4]]
            if not any(a <= m[2] and m[3] <= b and (n, -t) > (m[1], -m[0]) for t, n, a, b in others):
                kept.append(m)
        inside = [(t, n, a, b) for t, n, _, _, parts in kept for a, b in parts]
        out = [m for m in out if not any(a <= m[2] and m[3] <= b and (n, -t) > (m[1], -m[0]) for t, n, a, b in inside)]
        return sorted([*out, *[m[:4] for m in kept]], key=lambda m: (m[2], -m[3], -m[1], m[0]))


def _band(template: list[int]) -> int:
    return max(3, len(template) // 8)


def _outside(hits: list[tuple[int, int]], matches: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """The hits, in text order, that do not start inside a match."""
    spans = sorted((m[2], m[3]) for m in matches)
    out, k, until = [], 0, -1
    for p, place in hits:
        while k < len(spans) and spans[k][0] <= p:
            until = max(until, spans[k][1])
            k += 1
        if p > until:
            out.append((p, place))
    return out


def chain(hits: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """Hits in increasing order of text and of template that cover the most template words, the latest start of equals."""
    if not hits:
        return []
    none = (0, -1, -1)  # words covered, start in the text, last hit
    at, tree, before, best = [none] * size, [none] * (size + 1), [-1] * len(hits), none
    i = 0
    while i < len(hits):
        p, new = hits[i][0], []
        while i < len(hits) and hits[i][0] == p:
            place = hits[i][1]
            top, k = none, place - GRAM + 1
            while k > 0:
                top, k = max(top, tree[k]), k & (k - 1)
            top = max([(top[0] + GRAM, *top[1:]), *[(at[place - g][0] + g, *at[place - g][1:]) for g in range(1, GRAM) if place >= g and at[place - g] != none]])
            before[i] = top[2]
            new.append((place, (top[0], top[1] if top[2] >= 0 else p, i)))
            i += 1
        for place, value in new:
            if value > at[place]:
                at[place] = value
                best = value if value[:2] > best[:2] else best
                k = place + 1
                while k <= size:
                    tree[k], k = max(tree[k], value), k + (k & -k)
    out, k = [], best[2]
    while k >= 0:
        out.append(hits[k])
        k = before[k]
    return out[::-1]


def full_length(template: list[int], text: list[int]) -> list[int]:
    """Length of the longest common subsequence of the template and each start of the text (bit-parallel)."""
    masks: dict[int, int] = {}
    for k, x in enumerate(template):
        masks[x] = masks.get(x, 0) | 1 << k
    full = v = (1 << len(template)) - 1
    out, n = [], 0
    for x in text:
        m = masks.get(x)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
            n = len(template) - v.bit_count()
        out.append(n)
    return out


def split_matches(template: list[int], words: np.ndarray, hits: list[tuple[int, int]], min_coverage: float) -> list[tuple[int, int, int, list[tuple[int, int]]]]:
    """Matches along chains of hits: matched words, first and last word of the text, and the parts of the text between insertions."""
    band, found = _band(template), []
    while hits:
        own = chain(hits, len(template))
        # text to align: around the hits, without the inner part of long insertions
        parts, keep = [], []
        begin = max(0, own[0][0] - own[0][1] - band)
        head = own[0][0]
        for (p, place), (q, after) in zip(own, own[1:], strict=False):
            reach = max(0, after - place - GRAM) + band
            if q - p - GRAM > 2 * reach:
                keep.append((begin, p + GRAM + reach))
                parts.append((head, p + GRAM - 1))
                begin, head = q - reach, q
        p, place = own[-1]
        keep.append((begin, min(len(words), p + len(template) - place + band)))
        parts.append((head, p + GRAM - 1))
        places = [k for a, b in keep for k in range(a, b)]
        text = [int(words[k]) for k in places]
        lengths = full_length(template, text)
        matched = lengths[-1]
        if matched < min_coverage * len(template):
            break
        last = lengths.index(matched)
        back = full_length(template[::-1], text[last::-1]).index(matched)
        first, last = places[last - back], places[last]
        parts[0], parts[-1] = (min(first, parts[0][0]), parts[0][1]), (parts[-1][0], max(last, parts[-1][1]))
        found.append((matched, first, last, parts))
        gone = set(own)
        hits = [h for h in hits if h not in gone and not any(a <= h[0] <= b for a, b in parts)]
    return found


def _outermost(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Without those inside the span of one of more words (or of as many and an earlier template)."""
    out, furthest = [], []
    for m in sorted(set(found), key=lambda m: (m[2], -m[3], -m[1], m[0])):
        furthest = [x for x in furthest if x[3] >= m[2]]
        if any(x[2] <= m[2] and m[3] <= x[3] and (x[1], -x[0]) > (m[1], -m[0]) for x in furthest):
            continue
        out.append(m)
        furthest.append(m)
    return [m for m in out if not any(x is not m and x[2] == m[2] and x[3] == m[3] and (x[1], -x[0]) > (m[1], -m[0]) for x in furthest)]


def _grams(words: np.ndarray) -> np.ndarray:
    n = min(GRAM, len(words))
    if not n:
        return np.array([], np.uint64)
    out = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        out = (out ^ words[i : len(words) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def scan_licenses(df: DataFrame, templates: list[tuple[str, str]], text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), min_coverage: float = 0.8) -> DataFrame:
    """A row for each match: ``keep``, ``license``, ``template`` (its place in the list), ``matched`` and ``template_words``, ``coverage``, ``start`` and ``end`` (characters)."""
    index = df.sparkSession.sparkContext.broadcast(LicenseIndex.build(templates))
    new = [T.StructField("license", T.StringType()), T.StructField("template", T.IntegerType()), T.StructField("matched", T.IntegerType()), T.StructField("template_words", T.IntegerType()), T.StructField("coverage", T.DoubleType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]
    schema = T.StructType([df.schema[c] for c in keep] + new)
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, kept = index.value, {}
        for batch in pieces(batches):
            rows: list[tuple] = []
            which: list[int] = []
            for i, value in enumerate(batch.column(n)):
                text = value.as_py()
                if not text:
                    continue
                folded = fold(text)
                parts = folded.split()
                if len(kept) > MAX_WORDS_KEPT:
                    kept.clear()
                for w in set(parts).difference(kept):
                    kept[w] = xxhash.xxh3_64_intdigest(w)
                words = np.fromiter(map(kept.__getitem__, parts), np.uint64, len(parts))
                matches = own.scan(words, min_coverage)
                if not matches:
                    continue
                solid = np.concatenate([[False], np.frombuffer(folded, np.uint8) != 32, [False]])
                starts, ends = np.flatnonzero(solid[1:] & ~solid[:-1]), np.flatnonzero(solid[:-1] & ~solid[1:])
                data = text.encode("utf-8")
                for t, matched, first, last in matches:
                    a = len(data[: starts[first]].decode("utf-8"))
                    b = a + len(data[starts[first] : ends[last]].decode("utf-8"))
                    size = len(own.templates[t])
                    rows.append((own.names[t], t, matched, size, matched / size, a, b))
                    which.append(i)
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32()), strict=True)]
                yield pa.RecordBatch.from_arrays([c.take(pa.array(which)) for c in batch.columns[:n]] + columns, schema.names)

    return bounded_batches(df).select(*[F.col(quoted(c)) for c in keep], F.col(quoted(text_col))).mapInArrow(run, schema)
