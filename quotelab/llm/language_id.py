"""Language identification by unigrams over the pieces of a public vocabulary, summed over all segmentations.

A language gives every piece of the vocabulary a probability. The probability of a word is the sum, over all ways to cut
it into pieces, of the product of their probabilities; a forward pass over the word's bytes computes it. A text's
score is the product over its words, and the language with the largest posterior wins. The single bytes are pieces too,
so every text has a score. The probabilities come from expectation maximisation: forward and backward passes
share each word of the training sample among the pieces of its segmentations.

Words are lower-cased (ASCII) runs without ASCII digits, punctuation and white space, led by a space. They are never cut,
and no piece that can stand in a word is left out: words of up to ``SHORT`` bytes are summed as they are, longer ones in
logarithms, where nothing underflows. A null text, or one without any letter, is ``und`` with score 0. Rows with a null language or
text teach nothing; without any training rows every text is ``und``. Repeated rows are scored and counted one by one.
"""
from __future__ import annotations

import json
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelab.llm.texts import batch, keyed_text, whole_rows
from quotelab.llm.worker import kept
from quotelab.session import discard, materialise

#: Labelled rows a language is fitted on, as an expectation: each row is taken with this number over the language's rows.
TRAIN_ROWS = 4000
ROUNDS = 3
#: Longest word summed without logarithms: a piece has a probability above 1e-12, so products of 24 stay above 1e-300.
SHORT = 24
#: Words and their bytes whose scores a worker holds, bytes of text scored together (one text at least), numbers of a lattice.
HELD_WORDS, HELD_BYTES, TEXT_BYTES, CELLS = 120_000, 8_000_000, 4_000_000, 1_000_000
UNKNOWN = "und"

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    """The words that are scored, each led by a space."""
    return [b" " + w for w in text.translate(_WORDS).split()] if text else []


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    if any(97 <= c <= 122 for c in set(text.translate(_WORDS))):
        return True
    return not text.isascii() and any(map(str.isalpha, text.decode("utf-8", "replace")))


def vocabulary_pieces(path: str) -> list[bytes]:
    """The lower-cased pieces of a byte-level vocabulary file that can stand in a word, and all single bytes."""
    plain = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c <= 255]
    other = [c for c in range(256) if c not in plain]
    byte_of = {chr(c): c for c in plain} | {chr(256 + k): c for k, c in enumerate(other)}
    with open(path, encoding="utf-8") as f:
        known = json.load(f)["model"]["vocab"]
    pieces = (bytes(byte_of[c] for c in piece) for piece in known if all(c in byte_of for c in piece))
    lower = (p.lower() for p in pieces)
    return sorted({p for p in lower if p[1:].translate(_WORDS) == p[1:] and b" " not in p[1:]} | {bytes([c]) for c in range(256)})


class Pieces:
    """The vocabulary as a table of hashes, to look up all parts of many words at once."""

    _BASE, _MIX, _BITS = 0x9E3779B97F4A7C15, np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(64 - 18)

    def __init__(self, pieces: dict[bytes, int]):
        self.none = len(pieces)
        #: The lengths there are.
        self.lengths = np.array(sorted({len(p) for p in pieces}), np.int64)
        self._up = self._down = np.ones(1, np.uint64)
        hashes = np.array([sum((c + 1) * pow(self._BASE, i, 2**64) for i, c in enumerate(piece)) % 2**64 for piece in pieces], np.uint64)
        buckets = (hashes * self._MIX) >> self._BITS
        order = np.argsort(buckets, kind="stable")
        self._hash, self._id = np.append(hashes[order], np.uint64(0)), np.append(np.fromiter(pieces.values(), np.int32)[order], self.none)
        self._first = np.searchsorted(buckets[order], np.arange((1 << 18) + 1, dtype=np.uint64)).astype(np.int32)
        self._most = int(np.diff(self._first).max(initial=0))

    def sums(self, group: list[bytes]) -> np.ndarray:
        """Prefix sums of hashes of words of one length, from which the hash of any span follows."""
        n = len(group[0])
        if n >= len(self._up):
            self._up, self._down = (np.cumprod(np.array([1] + [x] * 2 * n, np.uint64), dtype=np.uint64) for x in (self._BASE, pow(self._BASE, -1, 2**64)))
        x = np.frombuffer(b"".join(group), np.uint8).reshape(len(group), n).astype(np.uint64) + np.uint64(1)
        sums = np.zeros((len(group), n + 1), np.uint64)
        np.cumsum(x * self._up[:n], axis=1, dtype=np.uint64, out=sums[:, 1:])
        return sums

    def ids(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The piece that each of the spans of each of the words is, or ``none``."""
        h = (sums[:, ends] - sums[:, starts]) * self._down[starts]
        bucket = (h * self._MIX) >> self._BITS
        at, end = self._first[bucket], self._first[bucket + np.uint64(1)]
        out = np.full(h.shape, self.none, np.int32)
        for _ in range(self._most):
            hit = (at < end) & (self._hash[at] == h)
            out[hit] = self._id[at[hit]]
            at = np.minimum(at + 1, end)
        return out


@dataclass
class Model:
    languages: list[str]
    log_prior: np.ndarray
    pieces: dict[bytes, int]
    #: Piece x language; one more row of zeros, for what is no piece.
    p: np.ndarray

    def __post_init__(self):
        self.table = Pieces(self.pieces)
        self.log_p = _logs(self.p)


class Lattice:
    """The segmentations of words of one length: ``ids[:, k]`` is the piece at the bytes ``spans[k]``."""

    def __init__(self, group: list[bytes], table: Pieces):
        self.n = n = len(group[0])
        self.spans = [(i - l, i) for i in range(1, n + 1) for l in table.lengths.tolist() if l <= i]
        self.ids = table.ids(table.sums(group), *np.array(self.spans).T)

    def forward(self, p: np.ndarray) -> np.ndarray:
        """Sums over the segmentations of each prefix; ``p`` has one row of values for each word and span."""
        a = np.zeros((self.n + 1, *p.shape[:1], *p.shape[2:]))
        a[0] = 1
        for k, (start, end) in enumerate(self.spans):
            a[end] += a[start] * p[:, k]
        return a

    def backward(self, p: np.ndarray) -> np.ndarray:
        b = np.zeros((self.n + 1, *p.shape[:1], *p.shape[2:]))
        b[self.n] = 1
        for k in range(len(self.spans) - 1, -1, -1):
            start, end = self.spans[k]
            b[start] += b[end] * p[:, k]
        return b


class LongLattice:
    """The segmentations of long words, one after another padded to one length, in logarithms.

    The pieces that end at ``WIDTH`` places are looked up at a time, so a word of any length needs little more than its own bytes.
    """

    WIDTH = 64

    def __init__(self, group: list[bytes], table: Pieces):
        self.table, self.ends = table, np.array([len(w) for w in group])
        self.n = int(self.ends.max())
        self.sums = table.sums([w.ljust(self.n, b"\0") for w in group])

    def _slices(self, backward: bool = False):
        """(end, starts, ids) of all places: ids has a row for each start."""
        lengths = self.table.lengths
        lows = range(1, self.n + 1, self.WIDTH)
        for low in reversed(lows) if backward else lows:
            ends = np.arange(low, min(low + self.WIDTH, self.n + 1))
            starts = ends[:, None] - lengths
            ids = self.table.ids(self.sums, np.maximum(starts, 0).ravel(), np.repeat(ends, len(lengths)))
            ids = ids.reshape(-1, len(ends), len(lengths)).transpose(1, 2, 0)
            for k in range(len(ends))[::-1] if backward else range(len(ends)):
                fits = starts[k] >= 0
                yield int(ends[k]), starts[k][fits], ids[k][fits]

    def total(self, log_p: np.ndarray) -> np.ndarray:
        """log of the sum over segmentations, word x column of ``log_p``; holds the sums of as many places as a piece is long."""
        ring = int(self.table.lengths[-1]) + 1
        a = np.full((ring, len(self.ends), log_p.shape[1]), -np.inf)
        out = np.full(a.shape[1:], -np.inf)
        a[0] = 0
        for end, starts, ids in self._slices():
            a[end % ring] = np.logaddexp.reduce(a[starts % ring] + log_p[ids], axis=0)
            done = self.ends == end
            out[done] = a[end % ring, done]
        return out

    def expected(self, log_p: np.ndarray, column: np.ndarray):
        """(pieces, words, expected counts) of the spans of the words, each by its own column of ``log_p``."""
        a = np.full((self.n + 1, len(self.ends)), -np.inf)
        a[0] = 0
        for end, starts, ids in self._slices():
            a[end] = np.logaddexp.reduce(a[starts] + log_p[ids, column], axis=0)
        whole = a[self.ends, np.arange(len(self.ends))]
        z = np.full(a.shape, -np.inf)
        z[self.ends, np.arange(len(self.ends))] = 0
        for end, starts, ids in self._slices(backward=True):
            step = log_p[ids, column] + z[end]
            z[starts] = np.logaddexp(z[starts], step)
            share = np.exp(a[starts] + step - whole)
            k, word = np.nonzero(share)
            yield ids[k, word], word, share[k, word]


def _groups(items: list[bytes], table: Pieces, columns: int):
    """(indices, lattice) of all ``items``, in groups of bounded size: short words by length, long ones by about their length."""
    columns = max(columns, 1)
    short: dict[int, list[int]] = {}
    for i, w in enumerate(items):
        short.setdefault(len(w) if len(w) <= SHORT else 0, []).append(i)
    long = sorted(short.pop(0, []), key=lambda i: len(items[i]))
    for n, g in short.items():
        most = max(1, CELLS // (n * min(n, len(table.lengths)) * columns))
        for at in range(0, len(g), most):
            yield g[at:at + most], Lattice([items[i] for i in g[at:at + most]], table)
    while long:
        # The last is the longest: it bounds the padded bytes, and the sums of a group over a piece's length.
        most = max(1, min(CELLS // (2 * len(items[long[-1]])), CELLS // (LongLattice.WIDTH * len(table.lengths) * columns)))
        g, long = long[-most:], long[:-most]
        yield g, LongLattice([items[i] for i in g], table)


def _logs(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(p)


def log_scores(items: list[bytes], model: Model) -> np.ndarray:
    """log P(word | language), word x language."""
    out = np.empty((len(items), len(model.languages)))
    for group, lattice in _groups(items, model.table, len(model.languages)):
        out[group] = lattice.total(model.log_p) if isinstance(lattice, LongLattice) else _logs(lattice.forward(model.p[lattice.ids])[-1])
    return out


def _count_words(batches):
    for b in batches:
        counts: dict[str, Counter] = {}
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            counts.setdefault(lang, Counter()).update(words(text))
        rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        lang, word, n = zip(*rows, strict=True) if rows else ((), (), ())
        yield batch({"lang": (lang, pa.string()), "word": (word, pa.binary()), "n": (n, pa.int64())})


def _expect(model: Model):
    def run(batches):
        at = {lang: k for k, lang in enumerate(model.languages)}
        total = np.zeros(model.p.shape)
        for b in batches:
            items, n = b.column("word").to_pylist(), b.column("n").to_numpy()
            lang = np.array([at[x] for x in b.column("lang").to_pylist()], np.int64)
            for group, lattice in _groups(items, model.table, 1):
                if isinstance(lattice, LongLattice):
                    for piece, word, share in lattice.expected(model.log_p, lang[group]):
                        np.add.at(total, (piece, lang[group][word]), share * n[group][word])
                    continue
                p = model.p[lattice.ids, lang[group][:, None]]
                a, z = lattice.forward(p), lattice.backward(p)
                weight = n[group] / a[-1]
                for k, (start, end) in enumerate(lattice.spans):
                    np.add.at(total, (lattice.ids[:, k], lang[group]), a[start] * p[:, k] * z[end] * weight)
        piece, lang = np.nonzero(total[:-1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(piece, pa.int64()), pa.array(lang, pa.int64()), pa.array(total[piece, lang])], names=["piece", "lang", "n"])
    return run


def train(docs: DataFrame, vocabulary: str, rows: int = TRAIN_ROWS, rounds: int = ROUNDS, smoothing: float = 0.01,
          id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on about ``rows`` labelled rows of each language; what reaches the driver is a number per piece and language."""
    known = docs.select(docs[text_col].cast("binary").alias("text"), docs[lang_col].cast("string").alias("lang"),
                        F.xxhash64(docs[id_col], docs[text_col]).alias("h")).filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    pieces = {p: k for k, p in enumerate(vocabulary_pieces(vocabulary))}
    prior = np.array([sizes[x] for x in languages], float)
    p = np.vstack([np.full((len(pieces), len(languages)), 1 / len(pieces)), np.zeros((1, len(languages)))])
    model = Model(languages, np.log(prior / max(prior.sum(), 1)), pieces, p)
    if not languages:
        return model
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, rows / sizes[lang]))])
    taken = known.filter(F.pmod("h", F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    counted = materialise(taken.mapInArrow(_count_words, "lang string, word binary, n long").groupBy("lang", "word").agg(
        F.sum("n").alias("n")), "words")
    for _ in range(rounds):
        found = counted.mapInArrow(_expect(model), "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n"))
        counts = np.full((len(pieces) + 1, len(languages)), smoothing)
        got = found.toArrow()
        counts[got["piece"].to_numpy(), got["lang"].to_numpy()] += got["n"].to_numpy()
        counts[-1] = 0
        model.p = counts / counts.sum(axis=0)
        model.log_p = _logs(model.p)
    discard(counted)
    return model


class Scorer:
    """Scores texts, holding the word scores of a bounded number of words."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.at, self.held, self.table = {}, 0, np.empty((0, len(self.model.languages)))

    def _learn(self, new: list[bytes]) -> None:
        self.at |= zip(new, range(len(self.at), len(self.at) + len(new)), strict=True)
        self.held += sum(map(len, new))
        self.table = np.vstack([self.table, log_scores(new, self.model)])

    def _scores(self, used: list[bytes]) -> np.ndarray:
        """log P(word | language) of distinct words, held ones from the table."""
        new = [w for w in used if w not in self.at]
        if len(self.at) + len(new) > HELD_WORDS or self.held + sum(map(len, new)) > HELD_BYTES:
            known = [w for w in used if w in self.at]
            rows = self.table[[self.at[w] for w in known]]
            self._forget()
            self.at, self.held, self.table = dict(zip(known, range(len(known)), strict=True)), sum(map(len, known)), rows
        if new:
            self._learn(new)
        return self.table[np.fromiter(map(self.at.__getitem__, used), np.int64, len(used))]

    def __call__(self, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for group in _by_bytes(texts):
            split = pc.split_pattern(pa.array([t.translate(_WORDS) if t else b"" for t in group], pa.large_binary()), b" ")
            coded = split.values.dictionary_encode()  # words as numbers, without an object for each
            which, ends = coded.indices.to_numpy(), split.offsets.to_numpy()
            used = coded.dictionary.to_pylist()
            table = self._scores([b" " + w for w in used if w])
            gap = used.index(b"") if b"" in used else len(used)  # between two separators: no word
            for k, text in enumerate(group):
                if not self.model.languages or not has_letter(text):
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                own = which[ends[k]:ends[k + 1]]
                own = own[own != gap]
                total = self.model.log_prior + table[own - (own > gap)].sum(axis=0)
                best = int(total.argmax())
                langs.append(self.model.languages[best])
                scores.append(float(1 / np.exp(total - total[best]).sum()))
        return langs, scores


def _by_bytes(texts: list[bytes | None]):
    """Runs of at most 256 texts and ``TEXT_BYTES``, or one text."""
    group, size = [], 0
    for t in texts:
        n = len(t) if t else 0
        if group and (size + n > TEXT_BYTES or len(group) == 256):
            yield group
            group, size = [], 0
        group.append(t)
        size += n
    if group:
        yield group


def identify(rows: DataFrame, model: Model, carried: str = "doc_id") -> DataFrame:
    """``carried``, lang_pred and score for rows with ``carried`` and a binary ``text``."""
    held = rows.sparkSession.sparkContext.broadcast(model)  # pieces x languages numbers, whatever the input

    def run(batches):
        scorer = kept(("scorer", id(held.value)), lambda: Scorer(held.value))  # which holds the model, so no other has its id
        for b in batches:
            langs, scores = scorer(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(carried), pa.array(langs), pa.array(scores, pa.float64())],
                                             names=[carried, "lang_pred", "score"])

    schema = rows.select(carried).schema.add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: Model, min_score: float = 0.4, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that have no language, or whose best language is less likely than ``min_score``."""
    found = identify(whole_rows(docs, text_col), model, "row")
    kept = found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string")) % 4 == 2


def predictions(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the documents that are not held out."""
    out = F.coalesce(held_out(docs["doc_id"]), F.lit(False))
    model = train(docs.filter(~out), vocabulary)
    return identify(keyed_text(docs), model).withColumn("held_out", F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
