"""Free-entered values mapped to a canonical list, unmatched ones reported.

Values are deduplicated, so the cost follows spellings rather than rows. A value and every form of a canonical entry are
normalised alike; character n-grams of the forms make an inverted index whose postings, weighted by rarity, give the cosine of
every form that shares a gram with the value, for a block of values at a time (a sparse product). The value is accepted as the
entry of greatest cosine where that is at least ACCEPT and ahead of every other entry by LEAD, unless it has too many or too few
letters (repeated parts have equal grams). Cosines that don't decide are
followed by an exact check of all forms that share a gram and whose letters allow it: at most two slips of the pen (a letter more,
less, other, or two swapped), in the order written or with the words sorted; the best must be ahead by a slip, or by MARGIN in
cosine. A value that passes neither is reported as unmatched (the empty string).

Forms by rule: the entry itself; "A, B of" also as "B of A", as "A" and with B's initials; its code, where it has one, letter by
letter; its aliases. A value may carry an article, a qualifier in brackets behind it, common abbreviations of the words that
the list itself uses, or a place name and a comma before it. A place name alone matches nothing.

The canonical list is a fixed table and is broadcast; more than MAX_ENTRIES entries are an error. Null values are no values;
blank ones map to ''. Values of fewer than four letters match only letter by letter.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ENTRIES = 20_000
ACCEPT = 0.66
LEAD = 0.1
MIN_COSINE = 0.05
MARGIN = 0.05
HITS = 4_000_000  # postings taken together
MAX_SLIPS = 2
PAIRS = 50_000  # compared at a time

#: Short forms of words (fixed values); used only where the long word occurs in the canonical list.
SHORT = {"st": "saint", "snt": "saint", "ste": "saint", "rep": "republic", "fed": "federated", "n": "north", "northern": "north", "s": "south", "southern": "south", "e": "east", "eastern": "east", "w": "west", "western": "west", "utd": "united", "isl": "islamic", "comm": "commonwealth", "dem": "democratic"}
ARTICLES = ("the", "a", "an")
SMALL = ("of", "and", "the")


def words(value: str, short: dict[str, str]) -> list[str]:
    """Lower-case words without marks, accents, leading articles and bracketed qualifiers; short forms written out."""
    value = "".join(c for c in unicodedata.normalize("NFKD", value.lower()) if not unicodedata.combining(c))
    bare = re.sub(r"(?<=\w)\s*[\[(][^\])]*[\])]\W*$", "", value)
    found = [w for w in re.split(r"[\W_]+", bare if re.search(r"\w", bare) else value) if w]
    while len(found) > 1 and found[0] in ARTICLES:
        found = found[1:]
    return [short.get(w, w) for w in found]


def spellings(value: str, short: dict[str, str]) -> list[tuple[str, str]]:
    """(as written, words sorted) of the whole value and of what follows its last comma."""
    out = []
    for part in (value, value.rpartition(",")[2] if "," in value else ""):
        found = words(part, short)
        if found:
            plain = [w for w in found if w not in SMALL] or found
            out.append((" ".join(found), " ".join(sorted(plain))))
    return out


def entry_forms(name: str, short: dict[str, str]) -> set[str]:
    forms = {name}
    head, comma, tail = name.rpartition(",")
    if comma and head.strip() and tail.strip():
        initials = "".join(w[0] for w in re.findall(r"\w+", tail) if w.lower() not in SMALL)
        forms |= {f"{tail} {head}", head, *([f"{initials} {head}"] if len(initials) > 1 else [])}
    return {" ".join(words(f, short)) for f in forms} - {""}


def grams(text: str) -> set[str]:
    """Letters, neighbouring letters and letters with one between, by word; ends of words count as letters of pairs."""
    out = set()
    for w in text.split():
        p = f"^{w}$"
        out.update(w)
        out.update(p[i : i + 2] for i in range(len(p) - 1))
        out.update(f"{x}_{y}" for x, y in zip(p, p[2:]))
    return out


def slips(a: list[str], b: list[str]) -> np.ndarray:
    """Edit distance with swaps of neighbours for each pair, all pairs at once."""
    n = len(a)
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    wide = lambda xs, m: np.array([[ord(c) for c in x.ljust(m, "\0")] for x in xs], np.int32).reshape(len(xs), m)
    x, y = wide(a, int(la.max())), wide(b, int(lb.max()))
    w = y.shape[1]
    out = np.zeros(n, np.int32)
    old2, old = None, np.tile(np.arange(w + 1, dtype=np.int32), (n, 1))
    out[la == 0] = lb[la == 0]
    for i in range(1, x.shape[1] + 1):
        new = np.empty_like(old)
        new[:, 0] = i
        same = x[:, i - 1 : i] == y
        for j in range(1, w + 1):
            best = np.minimum(np.minimum(new[:, j - 1], old[:, j]) + 1, old[:, j - 1] + ~same[:, j - 1])
            if i > 1 and j > 1:
                swap = (x[:, i - 1] == y[:, j - 2]) & (x[:, i - 2] == y[:, j - 1])
                best = np.where(swap, np.minimum(best, old2[:, j - 2] + 1), best)
            new[:, j] = best
        ends = la == i
        out[ends] = new[ends, lb[ends]]
        old2, old = old, new
    return out


def few_slips(a: list[str], b: list[str]) -> np.ndarray:
    """slips(), but 2 also where a letter is missing between two that were swapped, which slips() counts as 3."""
    d = slips(a, b)
    for n in np.flatnonzero(d == MAX_SLIPS + 1):
        long, short = (a[n], b[n]) if len(a[n]) > len(b[n]) else (b[n], a[n])
        if len(long) == len(short) + 1:
            less = [long[:i] + long[i + 1 :] for i in range(len(long))]
            if slips(less, [short] * len(less)).min() <= MAX_SLIPS - 1:
                d[n] = MAX_SLIPS
    return d


def letter_counts(texts: list[str]) -> np.ndarray:
    """How often each letter occurs, by code modulo 64. A slip takes away one letter and adds one at most, a swap none."""
    out = np.zeros((len(texts), 64), np.int16)
    for i, text in enumerate(texts):
        np.add.at(out[i], [ord(c) % 64 for c in text], 1)
    return out


class Matcher:
    """The inverted index over the forms of a canonical list."""

    def __init__(self, entries: list[tuple[str, str]], codes: dict[str, str] | None = None) -> None:
        """entries: (name or alias, canonical result); codes: (code in lower case, result)."""
        known = {w for name, _ in entries for w in words(name, {})}
        self.short = {s: long for s, long in SHORT.items() if long in known and s not in known}
        self.codes = codes or {}
        pairs = sorted({(form, target) for name, target in entries for form in entry_forms(name, self.short)})
        self.forms = [f for f, _ in pairs]
        self.sorted = [" ".join(sorted([w for w in f.split() if w not in SMALL] or f.split())) for f in self.forms]
        self.targets = [t for _, t in pairs]
        self.names = sorted(set(self.targets))
        self.target = np.searchsorted(np.array(self.names, object), np.array(self.targets, object)) if self.names else np.zeros(0, np.int64)
        self.exact: dict[str, set[str]] = {}
        for f, t in zip(self.sorted, self.targets):
            self.exact.setdefault(f, set()).add(t)
        self.raw = {}
        for name, target in entries:
            self.raw.setdefault(name, target)
        self.gram: dict[str, int] = {}
        rows, cols = [], []
        for i, f in enumerate(self.forms):
            for g in grams(f):
                rows.append(self.gram.setdefault(g, len(self.gram)))
                cols.append(i)
        rows, cols = np.array(rows, np.int64), np.array(cols, np.int64)
        many = np.bincount(rows, minlength=len(self.gram))
        self.idf = np.log1p(len(self.forms) / np.maximum(1, many))
        self.rare = float(np.log1p(len(self.forms)))
        order = np.argsort(rows, kind="stable")
        self.posting, self.begin = cols[order], np.concatenate([[0], np.cumsum(many)])
        self.letters, self.sorted_letters = letter_counts(self.forms), letter_counts(self.sorted)
        self.norm = np.sqrt(np.bincount(cols, self.idf[rows] ** 2, len(self.forms)))

    def _cosines(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, form, cosine) of all forms with at least MIN_COSINE: values by grams times grams by forms."""
        of, gram, norm = [], [], np.zeros(len(texts))
        for k, text in enumerate(texts):
            gs = grams(text)
            ids = sorted(self.gram[g] for g in gs if g in self.gram)
            of += [k] * len(ids)
            gram += ids
            norm[k] = np.sqrt((self.idf[ids] ** 2).sum() + (len(gs) - len(ids)) * self.rare**2)
        of, gram = np.array(of, np.int64), np.array(gram, np.int64)
        many = self.begin[gram + 1] - self.begin[gram]
        found = []
        upto = np.cumsum(np.bincount(of, many, len(texts)))
        first = 0
        while first < len(texts):
            stop = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + HITS, side="right")))
            stop = min(stop, first + max(1, HITS // max(1, len(self.forms))))
            at = slice(*np.searchsorted(of, [first, stop]))
            g, m = gram[at], many[at]
            hit = self.posting[np.repeat(self.begin[g] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())] if len(g) else np.zeros(0, np.int64)
            product = np.bincount(np.repeat(of[at] - first, m) * len(self.forms) + hit, np.repeat(self.idf[g] ** 2, m), (stop - first) * len(self.forms)).reshape(stop - first, len(self.forms))
            cosine = product / np.maximum(1e-12, norm[first:stop, None] * self.norm)
            row, form = np.nonzero((cosine >= MIN_COSINE) & (product > 0))
            found.append((row + first, form, cosine[row, form]))
            first = stop
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def _allowed(self, texts: list[tuple[str, str]], of: np.ndarray, form: np.ndarray) -> np.ndarray:
        """Which pairs' letters allow for two slips, as written or with the words sorted."""
        apart = np.full(len(of), MAX_SLIPS + 1)
        for which, letters in ((0, self.letters), (1, self.sorted_letters)):
            more = letters[form] - letter_counts([t[which] for t in texts])[of]
            apart = np.minimum(apart, np.maximum(np.maximum(more, 0).sum(axis=1), np.maximum(-more, 0).sum(axis=1)))
        return apart <= MAX_SLIPS

    def _candidates(self, texts: list[tuple[str, str]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(forms, cosines) of each text, given as written and with its words sorted, that the exact check looks at."""
        of, form, cosine = self._cosines([w for w, _ in texts])
        ok = self._allowed(texts, of, form)
        of, form, cosine = of[ok], form[ok], cosine[ok]
        return [(form[of == k], cosine[of == k]) for k in range(len(texts))]

    def match(self, values: list[str]) -> list[str]:
        result = [""] * len(values)
        asked: list[tuple[int, str, str]] = []
        for i, value in enumerate(values):
            bare = value.strip()
            code = bare.lower() if len(bare) < 4 else ""
            if code in self.codes:
                result[i] = self.codes[code]
                continue
            written = spellings(value, self.short)
            whole = [self.exact[s] for _, s in written if s in self.exact]
            if whole:
                result[i] = next(iter(whole[0])) if len(whole[0]) == 1 else ""
                continue
            asked += [(i, w, s) for w, s in written if len(w) >= 4]
        if self.forms:
            for part in range(0, len(asked), 2000):
                self._near(asked[part : part + 2000], result)
        return result

    def _near(self, asked: list[tuple[int, str, str]], result: list[str]) -> None:
        """The values' entries by cosine, else by the exact check."""
        value = np.array([i for i, _, _ in asked], np.int64)
        of, form, cosine = self._cosines([w for _, w, _ in asked])
        code = value[of] * len(self.names) + self.target[form]  # a value and an entry
        order = np.lexsort((-cosine, code))
        best = order[np.append(True, np.diff(code[order]) != 0)] if len(order) else order  # greatest cosine of each
        best = best[np.lexsort((-cosine[best], value[of[best]]))]
        head = np.flatnonzero(np.append(True, np.diff(value[of[best]]) != 0)) if len(best) else best
        top = cosine[best[head]]
        after = np.where(np.append(head[1:], len(best)) - head > 1, cosine[best[np.minimum(head + 1, len(best) - 1)]], 0.0) if len(head) else top
        firsts = best[head]
        sure = (top >= ACCEPT) & (top - after >= LEAD) & self._allowed([(w, s) for _, w, s in asked], of[firsts], form[firsts])
        for n in best[head[sure]]:
            result[value[of[n]]] = self.names[self.target[form[n]]]
        rest = ~np.isin(value[of], value[of[best[head[sure]]]])
        of, form, cosine = of[rest], form[rest], cosine[rest]
        ok = self._allowed([(w, s) for _, w, s in asked], of, form)
        self._exact(asked, of[ok], form[ok], cosine[ok], result)

    def _exact(self, asked: list[tuple[int, str, str]], of: np.ndarray, form: np.ndarray, cosine: np.ndarray, result: list[str]) -> None:
        d: list[int] = []
        for part in range(0, len(of), PAIRS):
            near = range(part, min(part + PAIRS, len(of)))
            d += np.minimum(few_slips([asked[of[n]][1] for n in near], [self.forms[form[n]] for n in near]), few_slips([asked[of[n]][2] for n in near], [self.sorted[form[n]] for n in near])).tolist()
        best: dict[int, dict[str, tuple[int, float]]] = {}
        for n, dist in enumerate(d):
            if dist <= min(MAX_SLIPS, len(self.forms[form[n]]) // 2):
                per = best.setdefault(asked[of[n]][0], {})
                target, score = self.targets[form[n]], (dist, -cosine[n])
                per[target] = min(per.get(target, score), score)
        for i, per in best.items():
            ranked = sorted((score, t) for t, score in per.items())
            if len(ranked) == 1 or ranked[1][0][0] > ranked[0][0][0] or ranked[1][0][1] - ranked[0][0][1] >= MARGIN:
                result[i] = ranked[0][1]


def map_values(values: DataFrame, matcher: Matcher) -> DataFrame:
    """values: value (not null). (value, canonical, n) of each distinct value, with the rows that hold it; '' where it means no entry.

    The distinct values are spread over as many tasks as a shuffle has, however little they weigh: matching takes time, not space."""
    session = values.sparkSession
    shared = session.sparkContext.broadcast(matcher)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(shared.value.match(batch.column(0).to_pylist()), pa.string()), batch.column(1)], names=["value", "canonical", "n"])

    distinct = values.groupBy("value").agg(F.count("*").alias("n"))
    return distinct.repartition(int(session.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(run, "value string, canonical string, n bigint")
