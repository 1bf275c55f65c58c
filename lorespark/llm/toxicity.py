"""Toxicity by noisy-channel deobfuscation.

Tokens that mix letters with leetspeak, are spelled with separators or spaces, or double letters are decoded: a character
lattice holds what each sign may stand for (itself, letters, nothing, a gap between words), and Viterbi's algorithm finds the best
words under a trigram character model over all letters of the labelled texts, of any script. Tokens and runs of spelled letters have any
length; a token that has only one way through its lattice is its own decoding. The restored text (plain words and decoded ones)
is scored by the presence of words and word beginnings that speak for toxic texts, combined by a logistic model.

Learning. Labels come from rows whose crc32(doc_id as text) modulo 5 isn't 0. The fit takes all labelled
documents: one half gives log-odds of features, the other half the logistic weights,
so features that only a few copies share get no say. Features are counted on the executors; those with a support of three
documents or more, and of a two-hundredth of the toxic ones, and log-odds of LEAST_ODDS or more stay, which bounds their number by that of the
features of 200 documents. The character model counts all words of the labelled texts: its size is that of the alphabets cubed, at most. Sums of the
logistic model are made on the executors.

Cases: null and empty texts score by the share of toxic labels; a document without label is scored all the same; a doc_id with
several labels counts as toxic if one says so; without labels of both kinds every score is the toxic share, 0.49 at
most, so nothing is rejected; repeated rows each give a row; a null doc_id isn't learnt from and not held out, but scored; an empty
table gives an empty result; other columns are ignored, or carried along. Texts are read whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from . import common

PREFIXES = (4, 5, 6, 8)
LEAST_ODDS = 2.0
# What a sign may stand for besides itself.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c", "*": "aeiou"}
SEPARATORS = ".-_*~^'`,/\\"
COST = {"leet": 1.0, "bare": 2.5, "drop_separator": 0.5, "drop_sign": 7.0, "drop_repeat": 0.7, "drop_double": 5.0, "gap": 2.0}
MEMORY = 16 << 20  # bytes of remembered tokens, their overhead included

_class = np.zeros(256, np.uint8)
_class[97:123] = 1
_class[128:] = 1  # letters beyond ASCII
for _c in LEET:
    _class[ord(_c)] |= 2
for _c in SEPARATORS:
    _class[ord(_c)] |= 4
_strip = "!?.,;:\"'()[]{}<>%#&*|=~^/\\-_ "
_WORD = re.compile(r"[^\W\d_]+")
END = " "


class Trigrams:
    """Costs (negative logarithms) of a letter after two others; END stands before and after a word. Smoothed towards
    shorter contexts, so letters that the texts lack have a cost too."""

    def __init__(self, counts: dict[str, int]):
        self.three, self.two, self.one, self.before, self.pair = counts, Counter(), Counter(), Counter(), Counter()
        for gram, n in counts.items():
            self.two[gram[1:]] += n
            self.one[gram[2]] += n
            self.before[gram[1]] += n
            self.pair[gram[:2]] += n
        self.all, self.kinds = sum(self.one.values()), len(self.one) + 1
        self.known: dict[str, float] = {}

    def __call__(self, gram: str) -> float:
        if (got := self.known.get(gram)) is None:
            one = (self.one[gram[2]] + 1) / (self.all + self.kinds)
            two = (self.two[gram[1:]] + 10 * one) / (self.before[gram[1]] + 10)
            got = float(-np.log((self.three.get(gram, 0) + 10 * two) / (self.pair[gram[:2]] + 10)))
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[gram] = got
        return got


def bare(letter: str) -> str:
    """The ASCII letter that a letter with marks is built on, or nothing."""
    base = unicodedata.normalize("NFKD", letter)[0]
    return base if letter > "\x7f" and "a" <= base <= "z" else ""


class Decoder:
    """Viterbi decoding of noisy tokens: the best words that may stand behind a token, "" if it holds no letter."""

    def __init__(self, counts: dict[str, int]):
        self.cost = Trigrams(counts)
        self.known: dict[tuple[str, bool], str] = {}
        self.held = 0

    def __call__(self, token: str, spelled: bool = False) -> str:
        """spelled: gaps between words may be anywhere, not only at separators."""
        if (got := self.known.get((token, spelled))) is None:
            if self.held > MEMORY:
                self.known, self.held = {}, 0
            got = self.known[token, spelled] = self.decode(token, spelled)
            self.held += 320 + 4 * len(token)
        return got

    @staticmethod
    def ways(token: str, i: int) -> tuple[list[tuple[str, float]], float | None]:
        """(letters that the i-th sign may stand for, with costs; cost of leaving it out, if it can be)."""
        ch = token[i]
        if ch.isalpha():
            letters = [(ch, 0.0)] + ([(b, COST["bare"])] if (b := bare(ch)) else [])
        else:
            letters = [(x, COST["leet"]) for x in LEET.get(ch, "")]
        drop = COST["drop_separator"] if ch in SEPARATORS else None if letters and ch not in LEET else COST["drop_sign"]
        return letters, drop

    def decode(self, token: str, spelled: bool = False) -> str:
        states: dict[str, tuple[float, tuple | None]] = {END + END: (0.0, None)}  # last two letters: cost, letters so far from the last on
        cost = self.cost
        for i, ch in enumerate(token):
            letters, drop = self.ways(token, i)
            run = ch == token[i - 1 : i] and ch in (token[i - 2 : i - 1], token[i + 1 : i + 2])
            repeat = COST["drop_repeat" if run else "drop_double"]
            new: dict[str, tuple[float, tuple | None]] = {}

            def offer(state: str, score: float, word: tuple | None) -> None:
                if state not in new or score < new[state][0]:  # noqa: B023
                    new[state] = (score, word)  # noqa: B023

            def gapped(ab: str, score: float, word: tuple | None) -> tuple[float, tuple | None]:
                return score + COST["gap"] + cost(ab + END), (END, word)

            for ab, (score, word) in states.items():
                if drop is not None:
                    offer(ab, score + drop, word)
                    if ch in SEPARATORS and ab[1] != END:
                        offer(END + END, *gapped(ab, score, word))
                for x, price in letters:
                    offer(ab[1] + x, score + price + cost(ab + x), (x, word))
                    if x == ab[1]:
                        offer(ab, score + repeat, word)
                if spelled and letters and ab[1] != END:
                    s, w = gapped(ab, score, word)
                    for x, price in letters:
                        offer(END + x, s + price + cost(END + END + x), (x, w))
            states = new
        ends = [(score + (cost(ab + END) if ab[1] != END else 0.0), i) for i, (ab, (score, _)) in enumerate(states.items())]
        word, out = list(states.values())[min(ends)[1]][1], []
        while word:
            out.append(word[0])
            word = word[1]
        return "".join(reversed(out)).strip()


def noisy_words(words: common.Words) -> list[tuple[int, str, bool]]:
    """(text, token to decode, spelled) of the tokens between white space whose lattice has several ways, spelled-out runs joined."""
    out: list[tuple[int, str, bool]] = []
    if not len(words.start):
        return out
    kind = _class[words.data]
    sums = [np.concatenate(([0], np.cumsum((kind & bit) > 0))) for bit in (1, 6)]
    letters, signs = (s[words.end] - s[words.start] for s in sums)
    raw = words.data.tobytes()
    lead = np.flatnonzero((words.data & 0xC0) != 0x80)  # first byte of each character
    char = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    if len(char) != len(lead):  # not UTF-8 throughout: characters are compared as bytes
        lead, char = np.arange(len(words.data)), words.data
    first, last = np.searchsorted(lead, words.start), np.searchsorted(lead, words.end)
    size = last - first  # in characters
    same = np.zeros(len(char) + 1, np.int64)
    same[1:] = np.cumsum(np.concatenate(([False], (char[1:] == char[:-1]) & (kind[lead[1:]] == 1)))) if len(char) else 0
    double = same[last] - same[np.minimum(first + 1, last)] > 0
    for i in np.flatnonzero((letters >= 1) & (size > 2) & ((signs > 0) | double)).tolist():
        token = raw[words.start[i] : words.end[i]].decode("utf-8", "ignore").lower().strip(_strip)
        if obfuscated(token):
            out.append((int(words.text[i]), token, False))
    single = (size == 1) & ((kind[words.start] & 3) > 0)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], single.astype(np.int8), [0]))))
    for a, z in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        for t in np.unique(words.text[a:z]).tolist() if z - a >= 4 else ():
            own = np.flatnonzero(words.text[a:z] == t) + a
            if len(own) >= 4:
                run = b"".join(raw[x:z] for x, z in zip(words.start[own].tolist(), words.end[own].tolist(), strict=True)).decode("utf-8", "ignore").lower()
                # a word of one letter may stand before or after the spelled one; several spelled words may follow each other
                out += [(t, run, False), (t, run[1:], False), (t, run[:-1], False), (t, run, True)]
    return out


_PLAIN = re.compile(r"[^\W\d_]+|\d+|[\W_]*")


def obfuscated(token: str) -> bool:
    """Whether a token, stripped of signs at its ends, has three letters or signs for them and several ways through its lattice:
    it mixes letters with signs for letters, has separators, or repeats a letter thrice."""
    if _PLAIN.fullmatch(token):
        return bool(re.search(r"([^\W\d_])\1\1", token))
    n = sum(c.isalpha() for c in token)
    leet, separators = sum(c in LEET for c in token), sum(c in SEPARATORS for c in token)
    return n >= 1 and ((leet > 0 and n + leet >= 3) or (separators > 0 and n >= 3))


def features(words: common.Words, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each word and of each beginning of a longer word."""
    if not len(words.start):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    value, at = words.summed()
    running = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value)))
    text, out = [words.text], [words.hash]
    for n in PREFIXES:
        long = words.length > n
        part = running[at[long] + n] - running[at[long]]
        out.append(common.mix(part ^ np.uint64(0x51ED270B * n)))
        text.append(words.text[long])
    return np.concatenate(text), np.concatenate(out)


def restored(column: pa.Array, decode: Decoder) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, n_words): distinct features of each restored text, sorted by text."""
    data, off = common.utf8(column)
    plain = common.Words(data, off, common.ALNUM)
    text, feature = features(plain)
    noisy = noisy_words(common.Words(data, off, hashed=False))
    if found := [(t, w) for t, w in ((t, decode(x, spelled)) for t, x, spelled in noisy) if len(w) > 2]:
        more = common.Words(*common.utf8(pa.array([w for _, w in found])), common.ALNUM)
        t, f = features(more)
        text, feature = np.concatenate((text, np.array([t for t, _ in found])[t])), np.concatenate((feature, f))
    return text, feature, plain.n


def _unique(text: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.unique(text.astype(np.int64) << 32 | number.astype(np.int64))
    return pairs >> 32, pairs & 0xFFFFFFFF


def _known(text: np.ndarray, feature: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of the distinct features that are among the sorted ones."""
    if not len(among) or not len(feature):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(among, feature), len(among) - 1)
    has = among[at] == feature
    return _unique(text[has], at[has])


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """doc_id, text, half, y of all labelled rows that aren't held out.

    Labels grow with the documents, so both sides are shuffled whatever their size; held-out texts stay where they are.
    """
    own = F.col(id_col).cast("long")
    learnt = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(own.alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    known = known.where(learnt).groupBy("doc_id").agg(F.max("y").alias("y"))
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int")
    return common.texts(docs, id_col, text_col).where(learnt).join(known.hint("merge"), "doc_id").select("doc_id", "text", half.alias("half"), (F.col("y") > 0).cast("int").alias("y"))


class Model:
    """Sorted feature hashes with their log-odds, the logistic weights and the decoder's counts."""

    def __init__(self, counts, feature, odds, weights):
        self.counts, self.feature, self.odds, self.weights = counts, feature, odds, weights

    def columns(self, column: pa.Array, decode: Decoder) -> np.ndarray:
        """Per text: sum and maximum of the log-odds of its features, logarithm of its words."""
        text, feature, n_words = restored(column, decode)
        t, place = _known(text, feature, self.feature)
        out = np.zeros((len(n_words), 3))
        np.add.at(out[:, 0], t, self.odds[place])
        np.maximum.at(out[:, 1], t, self.odds[place])
        out[:, 2] = np.log1p(n_words)
        out[:, 0] = np.log1p(out[:, 0])
        return out

    def score(self, columns: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + columns @ self.weights[1:], -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, **options) -> Model:
    rows = common.written(training_rows(docs, labels, **options), "toxic-rows")

    def trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            total: Counter = Counter()
            for word, n in Counter(_WORD.findall("\n".join(b.column(1).to_pylist()).lower())).items():
                padded = END + END + word + END
                for i in range(len(padded) - 2):
                    total[padded[i : i + 3]] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["gram", "n"])

    # three letters each: bounded by the alphabets
    got = common.arrow_map(rows, trigrams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    counts = dict(zip(got["gram"].tolist(), got["n"].tolist(), strict=True))
    n = {(r["half"], r["y"]): r["count"] for r in rows.groupBy("half", "y").count().collect()}
    pos, neg = n.get((0, 1), 0), n.get((0, 0), 0)
    base = min(0.49, sum(v for (_, y), v in n.items() if y) / max(1, sum(n.values())))
    empty = Model(counts, np.empty(0, np.uint64), np.empty(0), np.array([np.log((base + 1e-3) / (1 - base + 1e-3)), 0, 0, 0]))
    if not pos or not neg or not n.get((1, 1)) or not n.get((1, 0)):
        return empty

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = Decoder(counts)
        for b in common.slices(batches):
            text, feature, _ = restored(b.column(1), decode)
            kinds, place = np.unique(feature, return_inverse=True)
            text, place = _unique(text, place)
            toxic = b.column(3).to_numpy()[text]
            seen = [np.bincount(place[toxic == y], minlength=len(kinds)) for y in (1, 0)]
            yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), *map(pa.array, seen)], ["feature", "toxic", "clean"])

    support = max(3, pos // 200)
    found = common.arrow_map(rows.where("half = 0"), counted, "feature long, toxic long, clean long")
    found = found.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where(F.col("toxic") >= support)
    odds = F.log((F.col("toxic") + 0.5) / (pos + 1)) - F.log((F.col("clean") + 0.5) / (neg + 1))
    found = found.select("feature", odds.alias("odds")).where(F.col("odds") >= LEAST_ODDS).toPandas()
    order = np.argsort(found["feature"].to_numpy(np.int64).view(np.uint64))
    model = Model(counts, found["feature"].to_numpy(np.int64).view(np.uint64)[order], found["odds"].to_numpy(float)[order], empty.weights)

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = Decoder(counts)
        for b in common.slices(batches):
            x = model.columns(b.column(1), decode)
            yield pa.RecordBatch.from_arrays([b.column(3), *(pa.array(c) for c in x.T)], ["y", "a", "b", "c"])

    judged = common.written(common.arrow_map(rows.where("half = 1"), columns, "y int, a double, b double, c double"), "toxic-columns")
    model.weights = logistic(judged, "y", ["a", "b", "c"])
    return model


def logistic(rows: DataFrame, y: str, columns: list[str], penalty: float = 0.05, rounds: int = 50) -> np.ndarray:
    """Weights (intercept first) of a ridge logistic regression, by Newton steps; each step's sums are one aggregate of the rows."""
    x = [F.lit(1.0), *map(F.col, columns)]
    k = len(x)
    w = np.zeros(k)
    ridge = np.diag([1e-6, *[penalty] * (k - 1)])
    for _ in range(rounds):
        z = sum((x[i] * F.lit(float(w[i])) for i in range(k)), F.lit(0.0))
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))
        df = rows.select(*[c.alias(f"x{i}") for i, c in enumerate(x)], p.alias("p"), F.col(y).cast("double").alias("y"))
        spread = F.col("p") * (1 - F.col("p")) + 1e-9
        slope = [F.sum(F.col(f"x{i}") * (F.col("y") - F.col("p"))) for i in range(k)]
        got = np.array(df.agg(*slope, *[F.sum(F.col(f"x{i}") * F.col(f"x{j}") * spread) for i in range(k) for j in range(k)]).first(), float)
        step = np.linalg.solve(got[k:].reshape(k, k) + ridge, got[:k] - ridge @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False, **options) -> DataFrame:
    """doc_id, held_out (crc32 remainder 0), score, predicted; row (all columns, if carried)."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, **options)
    df = common.texts(docs, id_col, text_col, carry)
    kept = [f for f in df.schema.fields if f.name == "row"]
    schema = StructType([*_parse_datatype_string("doc_id long, score double").fields, *kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = Decoder(model.counts)
        for b in common.slices(batches):
            p = model.score(model.columns(b.column(1), decode))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), *(b.column(f.name) for f in kept)], schema.names)

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    out = common.arrow_map(df, run, schema)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *[f.name for f in kept])


def remove_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that aren't predicted to be toxic, with all their columns."""
    return score(docs, labels, carry=True, **options).where("predicted = 0").select("row.*")
