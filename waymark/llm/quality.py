"""Statistics that tell natural prose from lists, tables and junk.

Every text gets statistics over its whole length, counted over Arrow arrays: a batch is cut into lines, tokens and words once,
distinct tokens are looked at once, and sums per text are gathered from them. What is common in a language is learnt from the
texts: words by their document frequency among the texts that name the language, and how such words follow one another by the
document frequency of their pairs. A text's language is the one under which its common words are most likely.

Per language, mean and covariance of prose are estimated robustly: sums weighted by 1 / (1 + distance), without the far ones, are
taken over all texts that hold common words, again and again until mean and scales settle (the driver sees one small matrix a
language). A text's squared Mahalanobis distance from its language's prose says how far it is from prose, each statistic's part
in it why. Deviations of a short text count less, as its shares are less certain.

A text beyond the cut is not prose; nothing else decides that. Its kind follows from the parts and lines: junk where the
statistics of spelling and word order (ODD) make up the distance of a junk text, else table or list by what its lines are set as.

Null and blank texts have no statistics and no kind. A text without any common word takes the language that its row names, else
that of most texts. A language named by fewer than MIN_TEXTS texts is none of its own: its texts are held against the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.runtime import bounded_rows, cut_lineage

#: A word is common in a language where so large a share of its texts holds it; the most frequent MAX_COMMON count.
COMMON_SHARE, MAX_COMMON = 0.12, 200
#: Languages are the MAX_LANGUAGES most named ones with at least MIN_TEXTS texts.
MIN_TEXTS, MAX_LANGUAGES = 30, 32
STATS = ["word_count", "mean_word_length", "symbol_ratio", "digit_ratio", "line_end_share", "common_share", "words_per_line", "word_entropy", "separator_share", "vowel_share", "odd_share", "order_fit"]
#: Least scale of each statistic of prose, in the order of STATS: how a text is set (its length, lines) may vary more than how it is written.
LEAST_SCALE = np.array([1.0, 0.03, 0.03, 0.03, 0.5, 0.05, 1.0, 0.7, 0.03, 0.03, 0.03, 0.3])
#: Statistics of spelling and word order, which lists and tables share with prose; order counts where it is worse than chance.
ODD = ["vowel_share", "odd_share", "word_entropy", "order_fit"]
#: Sets of line features: characters in lines set as rows or pairs, and in all lines.
LINES = ["row_chars", "line_chars"]
#: Degrees of freedom of the weights, and words after which a deviation counts about whole.
FREEDOM, CERTAIN = 5.0, 20.0
MAX_ROUNDS, SETTLED = 60, 0.01
#: Texts are taken together up to so many characters.
TOGETHER = 4_000_000


def squared_quantile(p: float, k: int = len(STATS)) -> float:
    """The distance that a share p of normal prose keeps within (Wilson and Hilferty's approximation)."""
    return float(k * (1 - 2 / (9 * k) + NormalDist().inv_cdf(p) * np.sqrt(2 / (9 * k))) ** 3)


#: One normal prose text in 500 lies beyond.
CUT = squared_quantile(0.998)
FAR = 4.0 * len(STATS)
#: What the ODD statistics of a text make up in a list; a table's cells may look odder.
ODD_LIST, ODD_TABLE = squared_quantile(0.9, len(ODD)), 2 * CUT

_LINE = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\u0085  ]"
_VOWELS = "[aeiouyäöüáàâéèêëíìîïóòôúùûåæøœ]"
_END = "[.!?…][\"'”»)\\]]*$"
#: A line set as a table's row, or as a field and its value.
_BARS = r"\S[ \t]*[|\t]|^[ \t]*\|"
_GAPS = r"\S {2,}"
_PAIR = r"^\s*\pL[\pL\pM\d .()/_-]{0,38}?(?:\s*[:=]\s+|\t)\S.{0,60}$"
_BULLET = r"^\s*(?:[-*•–·‣+]|\[.?\]|\(?\d{1,4}[.)]|\(?[A-Za-z]{1,2}[.)]|[ivxIVX]{1,5}[.)])\s+\S"


def _array(x) -> np.ndarray:
    return x.to_numpy(zero_copy_only=False)


def _solid(parts: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Parent and value of the non-empty elements."""
    parent, flat = _array(pc.list_parent_indices(parts)).astype(np.int64), parts.flatten()
    keep = pc.greater(pc.binary_length(flat), 0)
    return parent[_array(keep)], flat.filter(keep)


class Texts:
    """Lines, tokens and words of a batch of texts, distinct tokens and words by number."""

    def __init__(self, texts: pa.Array) -> None:
        self.n = len(texts)
        self.line_text, self.lines = _solid(pc.split_pattern_regex(texts, _LINE))
        self.token_line, tokens = _solid(pc.utf8_split_whitespace(self.lines))
        coded = tokens.dictionary_encode()
        self.tokens, self.token = coded.dictionary, _array(coded.indices).astype(np.int64)
        self.token_text = self.line_text[self.token_line]
        of, words = _solid(pc.split_pattern_regex(pc.utf8_lower(self.tokens), r"[^\pL\pM]+"))
        coded = words.dictionary_encode()
        self.words, number = coded.dictionary, _array(coded.indices).astype(np.int64)
        many = np.bincount(of, minlength=len(self.tokens))
        first = np.concatenate([[0], np.cumsum(many)])
        each = many[self.token]
        ahead = np.concatenate([[0], np.cumsum(each)[:-1]]) if len(each) else np.zeros(0, np.int64)
        self.word = number[np.repeat(first[self.token] - ahead, each) + np.arange(each.sum())]
        self.word_text, self.word_line = np.repeat(self.token_text, each), np.repeat(self.token_line, each)

    def held(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, word, how often) of the distinct words of each text."""
        code, n = np.unique(self.word_text * max(1, len(self.words)) + self.word, return_counts=True)
        return code // max(1, len(self.words)), code % max(1, len(self.words)), n


def _batches(batch: pa.RecordBatch, text: int) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """The rows with a text that isn't blank, in parts of bounded size."""
    batch = batch.filter(pc.fill_null(pc.greater(pc.utf8_length(pc.utf8_trim_whitespace(batch.column(text))), 0), False))
    size = np.cumsum(_array(pc.binary_length(batch.column(text))).astype(np.int64))
    begin = 0
    while begin < batch.num_rows:
        before = size[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(size, before + TOGETHER, side="right")))
        part = batch.slice(begin, stop - begin)
        yield part, Texts(part.column(text).cast(pa.large_string()))
        begin = stop


def _named(lang: pa.Array) -> np.ndarray:
    return np.array([(x or "").strip().lower() for x in lang.to_pylist()], object)


class Learnt:
    """What is common in each language: words with their document frequencies, and how they follow one another."""

    def __init__(self, languages: list[str], texts: list[int], words: list[dict[str, float]]) -> None:
        self.languages, self.prior = languages, np.log(np.maximum(1, np.array(texts, float)))
        every = sorted({w for ws in words for w in ws})
        self.number = {w: i for i, w in enumerate(every)}
        self.share = np.array([[ws.get(w, 0.0) for ws in words] for w in every]).reshape(len(every), len(languages))
        self.code = np.zeros((len(every), len(languages)), np.int64)  # 1.. among the common words of a language, 0 for another word
        for k, ws in enumerate(words):
            own = [self.number[w] for w in sorted(ws)]
            self.code[own, k] = np.arange(1, len(own) + 1)
        self.fit: list[np.ndarray] = [np.zeros((len(ws) + 1, len(ws) + 1)) for ws in words]

    def codes(self, t: Texts, named: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The language of each text, and each word's code in the language of its text."""
        at = np.array([self.number.get(w, -1) for w in t.words.to_pylist()], np.int64)
        known = at[t.word] >= 0
        text, word = t.word_text[known], at[t.word[known]]
        likely = np.column_stack([np.bincount(text, np.log(np.maximum(0.01, self.share[word, k])), t.n) + self.prior[k] for k in range(len(self.languages))])
        lang = likely.argmax(axis=1)
        own = {x: k for k, x in enumerate(self.languages)}
        none = np.bincount(text, minlength=t.n) == 0
        lang[none] = [own.get(x, int(self.prior.argmax())) for x in named[none]]
        code = np.zeros(len(t.word), np.int64)
        code[known] = self.code[word, lang[text]]
        return lang, code

    def pairs(self, t: Texts, lang: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first code, second code) of neighbouring words of a text of which one at least is common."""
        near = (t.word_text[1:] == t.word_text[:-1]) & ((code[1:] > 0) | (code[:-1] > 0))
        return t.word_text[1:][near], code[:-1][near], code[1:][near]

    def learn_pairs(self, counts: dict[tuple[int, int, int], int]) -> None:
        """counts: (language, first, second) -> texts. The fit of a pair is the log of how much oftener it comes than by chance."""
        for k in range(len(self.languages)):
            n = np.zeros_like(self.fit[k])
            for (of, a, b), many in counts.items():
                if of == k:
                    n[a, b] = many
            total = max(1.0, n.sum())
            self.fit[k] = np.log(n / total + 0.3 / total) - np.log(np.outer(n.sum(axis=1), n.sum(axis=0)) / total**2 + 0.3 / total)


def _word_texts(df: DataFrame, text: str, lang: str) -> DataFrame:
    """(language, word, n): texts that name the language and hold the word; without a word the texts that name it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, t in _batches(batch, 0):
                names, of = np.unique(_named(part.column(1)).astype(str), return_inverse=True)
                in_text, word, _ = t.held()
                code, n = np.unique(of[in_text] * max(1, len(t.words)) + word, return_counts=True)
                texts = np.bincount(of, minlength=len(names))
                words = t.words.take(pa.array(code % max(1, len(t.words)))).cast(pa.string())
                yield pa.record_batch([pa.array([*names[code // max(1, len(t.words))], *names], pa.string()), pa.concat_arrays([words, pa.nulls(len(names), pa.string())]), pa.array(np.concatenate([n, texts]))], names=["language", "word", "n"])

    return df.select(text, lang).mapInArrow(run, "language string, word string, n bigint").groupBy("language", "word").agg(F.sum("n").alias("n"))


def learn(df: DataFrame, text: str, lang: str) -> Learnt:
    counted = cut_lineage(_word_texts(df, text, lang))
    named = bounded_rows(counted.where(f"word is null and language <> '' and n >= {MIN_TEXTS}").orderBy(F.col("n").desc(), "language").limit(MAX_LANGUAGES), MAX_LANGUAGES, "the list of languages")
    if not named:  # too few texts name any: all are of one language
        whole = counted.where("word is null").agg(F.sum("n")).collect()[0][0]
        counted, sizes = counted.groupBy(F.lit("").alias("language"), "word").agg(F.sum("n").alias("n")), {"": whole or 0}
    else:
        sizes = {r["language"]: r["n"] for r in named}
    least = df.sparkSession.createDataFrame([(x, n, COMMON_SHARE * n) for x, n in sizes.items()], "language string, texts bigint, least double")
    often = counted.where("word is not null").join(F.broadcast(least), "language").where("n >= least")
    words: dict[str, dict[str, float]] = {x: {} for x in sizes}
    # a text of many words may hold many common ones, so the list is cut where it is made
    per = often.groupBy("language").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "word", "texts"))), 1, MAX_COMMON).alias("best"))
    for r in per.collect():
        words[r["language"]] = {b["word"]: -b["less"] / b["texts"] for b in r["best"]}
    learnt = Learnt(list(sizes), list(sizes.values()), list(words.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = MAX_COMMON + 1
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, t in _batches(batch, 0):
                of, code = learnt.codes(t, _named(part.column(1)))
                in_text, a, b = learnt.pairs(t, of, code)
                once = np.unique(in_text * wide * wide + a * wide + b)
                of = of[once // wide**2]
                for k in np.unique(of):
                    total[k] = total.get(k, 0) + np.bincount(once[of == k] % wide**2, minlength=wide * wide)
        for k, n in total.items():
            at = np.flatnonzero(n)
            yield pa.record_batch([pa.array(np.full(len(at), k, np.int32)), pa.array((at // wide).astype(np.int32)), pa.array((at % wide).astype(np.int32)), pa.array(n[at])], names=["k", "a", "b", "n"])

    pairs = df.select(text, lang).mapInArrow(run, "k int, a int, b int, n bigint").groupBy("k", "a", "b").agg(F.sum("n").alias("n"))
    learnt.learn_pairs({(r["k"], r["a"], r["b"]): r["n"] for r in bounded_rows(pairs, MAX_LANGUAGES * (MAX_COMMON + 1) ** 2, "the pairs of common words")})
    return learnt


def odd_sizes(t: Texts) -> np.ndarray:
    """By token, the characters of its pieces between separators that are no word, number or mark: letters among digits, brackets
    and code marks, endless ones."""
    of, pieces = _solid(pc.split_pattern_regex(t.tokens, "[,;|:=]"))
    has = lambda pattern: _array(pc.match_substring_regex(pieces, pattern)).astype(bool)
    size = _array(pc.utf8_length(pieces)).astype(float)
    letter, digit = has(r"\pL"), has(r"\p{Nd}")
    odd = (letter & digit) | (size > 30) | (has(r"[<>{}\[\]&\\_\x{FFFD}@#$%^~]") & (letter | digit | (size > 1)))
    return np.bincount(of, odd * size, len(t.tokens))


def statistics(t: Texts, learnt: Learnt, lang: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The numbers of STATS by text; counts and lengths as logarithms."""
    n = t.n
    count = lambda pattern, of=t.tokens: _array(pc.count_substring_regex(of, pattern)).astype(float)
    has = lambda pattern: _array(pc.match_substring_regex(t.tokens, pattern)).astype(bool)
    by_text = lambda x: np.bincount(t.token_text, np.asarray(x, float)[t.token], n)
    size, letters, digits = _array(pc.utf8_length(t.tokens)).astype(float), count(r"[\pL\pM]"), count(r"\p{Nd}")
    solid, of_letters, of_digits = by_text(size), by_text(letters), by_text(digits)
    tokens, words = np.bincount(t.token_text, minlength=n), np.bincount(t.word_text, minlength=n)
    lines = np.maximum(1, np.bincount(t.line_text, minlength=n))
    last = np.flatnonzero(np.append(np.diff(t.token_line) != 0, True)) if len(t.token) else np.zeros(0, np.int64)
    ended = np.bincount(t.token_text[last], has(_END)[t.token[last]], n)
    full = np.maximum(1, np.bincount(t.token_text[last], minlength=n))
    in_text, _, often = t.held()
    part = often / np.maximum(1, words[in_text])
    entropy = np.bincount(in_text, -part * np.log2(part), n)
    of, a, b = learnt.pairs(t, lang, code)
    fits = np.zeros(len(of))
    for k in range(len(learnt.languages)):
        own = lang[of] == k
        fits[own] = learnt.fit[k][a[own], b[own]]
    share = lambda x, whole: x / np.maximum(1, whole)
    return np.column_stack([
        np.log1p(words), np.log1p(share(of_letters, words)), share(solid - of_letters - of_digits, solid), share(of_digits, solid), ended / full,
        share(np.bincount(t.word_text, code > 0, n), words), np.log1p(tokens / lines), entropy, share(by_text(has(r"[,;|:]$")), tokens),
        share(by_text(count(_VOWELS, pc.utf8_lower(t.tokens))), of_letters), share(by_text(odd_sizes(t)), solid), share(np.bincount(of, fits, n), words - 1),
    ])


def line_sizes(t: Texts, code: np.ndarray) -> np.ndarray:
    """The numbers of LINES by text. A line of many common words is no row."""
    bare = pc.utf8_trim_whitespace(t.lines)
    size = _array(pc.utf8_length(bare)).astype(float)
    count = lambda pattern: _array(pc.count_substring_regex(bare, pattern))
    has = lambda pattern: _array(pc.match_substring_regex(bare, pattern)).astype(bool)
    digits = count(r"\p{Nd}")
    words = np.bincount(t.word_line, minlength=len(size))
    common = np.bincount(t.word_line, code > 0, len(size)) / np.maximum(1, words)
    marks, gaps = count("[,;]"), count(_GAPS)
    listed = (marks >= 2) & ((digits > 0.15 * size) | ~has(r"\s"))
    spaced = (gaps >= 2) | ((gaps == 1) & has(r" {2,}[-+]?[\d.,]*\d$"))
    row = has(_BARS) | ((listed | spaced | (has(_PAIR) & ~has(_END))) & (common < 0.35))
    row &= ~has(_BULLET) | has(_BARS)
    return np.column_stack([np.bincount(t.line_text, row * size, t.n), np.bincount(t.line_text, size, t.n)])


def text_statistics(df: DataFrame, key: str, text: str, lang: str, learnt: Learnt) -> DataFrame:
    """(key, language, the STATS, the LINES) of every text that isn't null or blank."""
    names = [key, "language", *STATS, *LINES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, t in _batches(batch, 1):
                of, code = learnt.codes(t, _named(part.column(2)))
                x = np.column_stack([statistics(t, learnt, of, code), line_sizes(t, code)])
                yield pa.record_batch([part.column(0), pa.array(np.array(learnt.languages, object)[of], pa.string()), *[pa.array(np.ascontiguousarray(x[:, i])) for i in range(x.shape[1])]], names=names)

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text, lang).mapInArrow(run, f"`{key}` {kind}, language string, " + ", ".join(f"{s} double" for s in names[2:]))


class Prose:
    """Mean and covariance of prose by language."""

    def __init__(self) -> None:
        self.mean: dict[str, np.ndarray] = {}
        self.covariance: dict[str, np.ndarray] = {}
        self.rounds = 0

    @staticmethod
    def certainty(chars: np.ndarray) -> np.ndarray:
        """What deviations of a text count: the share over n words has a variance of its own that falls with n."""
        return np.sqrt(chars / (chars + 6 * CERTAIN))  # a word and its blank have about six characters

    def parts(self, langs: np.ndarray, x: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """Contribution of each statistic to the squared distance; they add up to it. Not-a-number without any prose."""
        out = np.full(x.shape, np.nan)
        for name in self.mean:
            at = langs == name
            d = (x[at] - self.mean[name]) * self.certainty(chars[at])[:, None]
            out[at] = d * (d @ np.linalg.inv(self.covariance[name]))
        return out


def fit_prose(stats: DataFrame) -> Prose:
    """Robust mean and covariance by language, from all texts that hold half the usual share of common words or more."""
    k = len(STATS)
    usual = stats.groupBy("language").agg(F.percentile_approx("common_share", 0.5, 1000).alias("usual"))
    usual = stats.sparkSession.createDataFrame([tuple(r) for r in bounded_rows(usual, MAX_LANGUAGES, "the list of languages")], "language string, usual double")
    seeds = stats.join(F.broadcast(usual), "language").where("common_share > usual / 2").select("language", *STATS, "line_chars")
    prose = Prose()
    for r in seeds.groupBy("language").agg(*[F.percentile_approx(s, [0.05, 0.5, 0.95], 1000).alias(s) for s in STATS]).collect():
        q = np.array([r[s] for s in STATS], float)
        prose.mean[r["language"]] = q[:, 1]
        prose.covariance[r["language"]] = np.diag(np.maximum(LEAST_SCALE, (q[:, 2] - q[:, 0]) / 3.29) ** 2)
    moving = set(prose.mean)
    while moving and prose.rounds < MAX_ROUNDS:
        shared = prose

        def sums(batches: Iterator[pa.RecordBatch], shared: Prose = shared) -> Iterator[pa.RecordBatch]:
            total: dict[str, np.ndarray] = {}
            for batch in batches:
                x, chars = np.column_stack([_array(batch.column(i + 1)) for i in range(k)]), _array(batch.column(k + 1))
                langs = np.array(batch.column(0).to_pylist(), object)
                distance = shared.parts(langs, x, chars).sum(axis=1)
                w = np.where(distance <= FAR, (FREEDOM + k) / (FREEDOM + distance), 0.0)
                f = shared.certainty(chars)
                for name in set(langs.tolist()):
                    at = langs == name
                    wf, wff, y = w[at] * f[at], w[at] * f[at] ** 2, x[at]
                    m = np.concatenate([[w[at].sum(), wf.sum(), wff.sum()], wf @ y, wff @ y, ((y * wff[:, None]).T @ y).ravel()])
                    total[name] = total.get(name, 0) + m
            for name, m in total.items():
                yield pa.record_batch([pa.array([name], pa.string()), pa.array([m.tolist()], pa.list_(pa.float64()))], names=["language", "m"])

        added = seeds.mapInArrow(sums, "language string, m array<double>").select("language", F.posexplode("m")).groupBy("language", "pos").agg(F.sum("col").alias("v"))
        sums_of: dict[str, np.ndarray] = {}
        for r in added.collect():  # as many rows as the matrices have numbers
            sums_of.setdefault(r["language"], np.zeros(3 + 2 * k + k * k))[r["pos"]] = r["v"]
        for name, m in sums_of.items():
            if name not in moving or m[0] <= 0:
                continue
            mean, y2, yy = m[3 : 3 + k] / m[1], m[3 + k : 3 + 2 * k], m[3 + 2 * k :].reshape(k, k)
            cov = (yy - np.outer(mean, y2) - np.outer(y2, mean) + np.outer(mean, mean) * m[2]) / m[0] + np.diag(LEAST_SCALE**2)
            old, scale = prose.mean[name], np.sqrt(np.diag(prose.covariance[name]))
            move = np.abs((mean - old) / scale).max() + np.abs(np.sqrt(np.diag(cov)) / scale - 1).max()
            prose.mean[name], prose.covariance[name] = mean, cov
            if move < SETTLED:
                moving.discard(name)
        prose.rounds += 1
    return prose


def kinds(parts: np.ndarray, order_fit: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """'junk', 'table' or 'list' of texts that aren't prose."""
    odd = parts[:, [STATS.index(s) for s in ODD[:-1]]].sum(axis=1) + np.where(order_fit < 0, parts[:, STATS.index(ODD[-1])], 0)
    table = 2 * lines[:, 0] > lines[:, 1]
    return np.where(odd > np.where(table, ODD_TABLE, ODD_LIST), "junk", np.where(table, "table", "list")).astype(object)


def prose_distances(df: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """(key, language, STATS, distance, part_<stat>..., kind): distance is squared, its parts add up to it; kind is null within CUT."""
    stats = cut_lineage(text_statistics(df, key, text, lang, learn(df, text, lang)))
    prose = fit_prose(stats)
    names = [key, "language", *STATS]
    added = ["distance", *[f"part_{s}" for s in STATS]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([_array(batch.column(i + 2)) for i in range(len(STATS) + len(LINES))])
            parts = prose.parts(np.array(batch.column(1).to_pylist(), object), x[:, : len(STATS)], x[:, -1])
            distance = parts.sum(axis=1)
            kind = pa.array(kinds(parts, x[:, STATS.index("order_fit")], x[:, len(STATS) :]), pa.string(), mask=distance <= CUT)
            yield pa.record_batch([*batch.columns[: len(names)], pa.array(distance), *[pa.array(np.ascontiguousarray(parts[:, i])) for i in range(len(STATS))], kind], names=[*names, *added, "kind"])

    of = df.schema[key].dataType.simpleString()
    return stats.mapInArrow(run, f"`{key}` {of}, language string, " + ", ".join(f"{s} double" for s in [*STATS, *added]) + ", kind string")


def not_prose(distances: DataFrame, key: str) -> DataFrame:
    """(key, kind) of the texts beyond the cut. Where no prose could be fitted, all count as beyond."""
    return distances.where("kind is not null").select(key, "kind")
