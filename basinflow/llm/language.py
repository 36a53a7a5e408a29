"""Language identification by cross-parsing: how few phrases of a language's labelled text does a text need?

For each language a suffix automaton of a bounded sample of labelled text is built. A text is cut greedily into longest matches
with the sample (Ziv-Merhav parsing); the count of phrases times the bits of a pointer into the sample, a symbol, is the cross
entropy, and the smallest wins. The automata are dense tables, so that many texts walk in step. A long text is walked in portions at
once; those that began in another state than the portion before ended in are walked again, until all fit: the parse is that of the
whole text.

Fitting: SAMPLE_DOCS different pieces a language at most (the first by a hash of doc_id), SAMPLE_PIECE symbols of each, from a place
anywhere in its text that the hash names, and SAMPLE_SYMBOLS in all.
Whole texts are parsed. Symbols are lower-case letters, anything else is one space.

Defined cases: a null text, or one without a letter, is "und" with score 0; without labelled rows every text is "und"; ties go to
the language first in order; repeated rows get equal rows; a null doc_id is never used for fitting. Other columns are not looked
at, except lang for fitting.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basinflow.llm.common import give_back, portions
from basinflow.session import ship

SAMPLE_DOCS, SAMPLE_PIECE, SAMPLE_SYMBOLS = 400, 160, 40_000
#: Symbols walked in one portion, and portions in step.
PORTION, TOGETHER = 1024, 4096
#: Texts classified at a time.
TEXTS = 2000
UNDETERMINED = "und"


@lru_cache(maxsize=1)
def lower_letters() -> np.ndarray:
    """For each code point below 65536 its lower-case letter (the first, if lower case takes several), or a space."""
    return np.array([ord(c.lower()[0]) if (c := chr(k)).isalpha() else 32 for k in range(65536)], np.uint16)


def symbols(text: str) -> np.ndarray:
    """Lower-case letters with single spaces between words; letters beyond 65535 count as the letter 65535."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    out = lower_letters()[np.minimum(codes, 65535)]
    beyond = np.flatnonzero(codes > 65535)
    if len(beyond):
        out[beyond] = [65535 if chr(c).isalpha() else 32 for c in codes[beyond]]
    space = out == 32
    keep = ~space
    keep[1:] |= ~space[:-1]
    out = out[keep]
    return out[1:] if len(out) and out[0] == 32 else out


def suffix_automaton(text: np.ndarray, width: int) -> np.ndarray:
    """Transitions [state, symbol] of the smallest automaton of all substrings; 0 is the start, -1 is none."""
    size, last = 1, 0
    links, lengths, moves = [-1], [0], [{}]
    for symbol in text.tolist():
        new = size
        size += 1
        links.append(0)
        lengths.append(lengths[last] + 1)
        moves.append({})
        at = last
        while at >= 0 and symbol not in moves[at]:
            moves[at][symbol] = new
            at = links[at]
        if at >= 0:
            to = moves[at][symbol]
            if lengths[to] == lengths[at] + 1:
                links[new] = to
            else:
                copy = size
                size += 1
                links.append(links[to])
                lengths.append(lengths[at] + 1)
                moves.append(dict(moves[to]))
                while at >= 0 and moves[at].get(symbol) == to:
                    moves[at][symbol] = copy
                    at = links[at]
                links[to] = links[new] = copy
        last = new
    table = np.full((size, width), -1, np.int32)
    for state, out in enumerate(moves):
        for symbol, to in out.items():
            table[state, symbol] = to
    return table


class CrossParser:
    """Automata of all languages over one alphabet; symbol 0 is any letter that no sample has."""

    def __init__(self, samples: tuple[tuple[str, str], ...]) -> None:
        texts = {lang: symbols(text) for lang, text in samples}
        self.langs = sorted(lang for lang, text in texts.items() if len(text))
        alphabet = np.unique(np.concatenate([texts[x] for x in self.langs])) if self.langs else np.empty(0, np.uint16)
        self.code = np.zeros(65536, np.int16)
        self.code[alphabet] = np.arange(1, len(alphabet) + 1)
        self.tables = [suffix_automaton(self.code[texts[x]], len(alphabet) + 1) for x in self.langs]
        self.bits = [math.log2(len(texts[x]) + 1) for x in self.langs]

    def walk(self, table: np.ndarray, portions: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that end in each row of codes, -1 being past its end, and the states behind it; begin: those before it."""
        rows = len(portions)
        state, count = begin.astype(np.int32), np.zeros(rows, np.int64)
        width = table.shape[1]
        flat, roots = table.ravel(), table[0]
        for column in portions.T:
            if column[0] < 0:  # rows are in order of falling length
                break
            live = int(np.searchsorted(-column, 0, side="right")) if column[-1] < 0 else rows
            symbol, here = column[:live], state[:live]
            to = flat[here.astype(np.int64) * width + symbol]
            stuck = to < 0
            if stuck.any():
                # A phrase ends before this symbol, which begins the next; a symbol of no sample is a phrase of its own.
                count[:live] += stuck & (here > 0)
                to = np.where(stuck, roots[symbol], to)
                count[:live] += to < 0
                to = np.maximum(to, 0)
            state[:live] = to
        return count, state

    def phrases(self, table: np.ndarray, parts: list[np.ndarray], owner: np.ndarray, n: int) -> np.ndarray:
        """Phrases of each of n texts, whose portions stand one after the other."""
        begin, end, count = (np.zeros(len(parts), np.int64) for _ in range(3))
        follows = np.flatnonzero(np.diff(owner, prepend=-1) == 0)
        wrong = np.arange(len(parts))
        while len(wrong):
            order = sorted(wrong.tolist(), key=lambda i: -len(parts[i]))
            for at in range(0, len(order), TOGETHER):
                some = order[at : at + TOGETHER]
                block = np.full((len(some), len(parts[some[0]])), -1, np.int16)
                for row, i in enumerate(some):
                    block[row, : len(parts[i])] = parts[i]
                count[some], end[some] = self.walk(table, np.asfortranarray(block), begin[some])
            wrong = follows[begin[follows] != end[follows - 1]]
            begin[wrong] = end[wrong - 1]
        last = np.flatnonzero(np.diff(owner, append=-1) != 0)
        out = np.bincount(owner, count, n) if len(owner) else np.zeros(n)
        out[owner[last]] += end[last] > 0
        return out

    def classify(self, texts: list[str | None]) -> list[tuple[str, float]]:
        parts, owner, lengths = [], [], np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            found = self.code[symbols(text)] if text else np.empty(0, np.int16)
            if not text or not any(map(str.isalpha, text)):
                continue
            lengths[k] = len(found)
            for at in range(0, len(found), PORTION):
                parts.append(found[at : at + PORTION])
                owner.append(k)
        owner = np.array(owner, np.int64)
        costs = np.array([self.phrases(table, parts, owner, len(texts)) * bits for table, bits in zip(self.tables, self.bits)]).reshape(len(self.langs), len(texts))
        out = []
        for k in range(len(texts)):
            if not lengths[k] or not self.langs:
                out.append((UNDETERMINED, 0.0))
                continue
            ranked = np.sort(costs[:, k])
            best = int(np.argmin(costs[:, k]))
            second = ranked[1] if len(ranked) > 1 else lengths[k] * self.bits[best]
            out.append((self.langs[best], float(min(1.0, max(0.0, 1 - ranked[0] / second)))))
        return out


_parser: dict[tuple, CrossParser] = {}


def parser(samples: tuple[tuple[str, str], ...]) -> CrossParser:
    """One set of automata for each Python worker; that of other samples goes before a new one is built."""
    if samples not in _parser:
        _parser.clear()
        _parser[samples] = CrossParser(samples)
    return _parser[samples]


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def least_pieces(batches):
    """The first SAMPLE_DOCS different (hash, doc_id, piece) of each language in these batches."""
    import pyarrow as pa

    least: dict[str, set[tuple]] = {}
    limit: dict[str, tuple] = {}
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("lang", "hash", "doc_id", "piece"))):
            lang, key = row[0], row[1:]
            if lang in limit and key >= limit[lang]:
                continue
            some = least.setdefault(lang, set())
            some.add(key)
            if len(some) >= 2 * SAMPLE_DOCS:
                some = least[lang] = set(sorted(some)[:SAMPLE_DOCS])
                limit[lang] = max(some)
    rows = [(lang, *key) for lang, some in least.items() for key in sorted(some)[:SAMPLE_DOCS]]
    names, types = ["lang", "hash", "doc_id", "piece"], [pa.string(), pa.int64(), pa.string(), pa.string()]
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def fit(docs: DataFrame) -> tuple[tuple[str, str], ...]:
    """(lang, text) pieces of labelled, not held-out rows: the first SAMPLE_DOCS different pieces a language by the hash of doc_id."""
    ship(docs.sparkSession)
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    place = 1 + F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.length("text") - 4 * SAMPLE_PIECE)).cast("int")
    pieces = rows.select("lang", F.xxhash64("doc_id").alias("hash"), F.col("doc_id").cast("string").alias("doc_id"), F.substring(F.col("text"), place, F.lit(4 * SAMPLE_PIECE)).alias("piece"))
    some = pieces.mapInArrow(least_pieces, "lang string, hash long, doc_id string, piece string").distinct()
    first = Window.partitionBy("lang").orderBy("hash", "doc_id", "piece")
    some = some.withColumn("k", F.row_number().over(first)).where(F.col("k") <= SAMPLE_DOCS)
    texts: dict[str, list[str]] = {}
    for r in some.orderBy("lang", "k").collect():
        texts.setdefault(r["lang"], []).append("".join(map(chr, symbols(r["piece"])[:SAMPLE_PIECE].tolist())))
    return tuple((lang, " ".join(p)[:SAMPLE_SYMBOLS]) for lang, p in sorted(texts.items()))


def identify(docs: DataFrame, samples: tuple[tuple[str, str], ...] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of docs and the prediction and its score, in columns of names that docs must not have."""
    import pyarrow as pa
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    ship(docs.sparkSession)
    samples = fit(docs) if samples is None else samples
    shared = docs.sparkSession.sparkContext.broadcast(samples)
    schema = StructType([*docs.schema.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())])

    def rows(batches):
        parse = parser(shared.value)
        for batch in portions(batches, TEXTS):
            found = parse.classify(batch.column("text").to_pylist())
            columns = [*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *names])
        give_back()

    return docs.mapInArrow(rows, schema)


def op8_language(spark, sf_dir):
    from basinflow.llm.common import table

    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
