"""Removal of long byte strings that an earlier document holds too, with a logarithmic family of suffix arrays.

A string of LEAST bytes occurs in an earlier document exactly if its smallest 20-byte piece, in a fixed random order, does so in
the same surroundings. So texts are cut into runs of windows that share such an anchor, and

1. anchors are dealt by hash; those of one document only are done with,
2. runs of shared anchors are dealt by anchor with their bytes; equal runs are settled by the smallest doc_id, and runs that differ
   are indexed: a batch gets a suffix array (of places in its bytes, in order to LEAST bytes), which is merge-scanned against those
   of the levels before it, and levels of like size merge, so that each suffix moves a logarithmic number of times,
3. covered ranges go back to their documents.

Settling equal runs first is what keeps this within its limits: most repeats are whole runs, and need no suffix to be sorted.

Before each shuffle a task keeps, of what many of its documents share, one entry and settles the others itself: a passage in a
third of all documents sends one entry a task. What moves is packed in arrays, by bucket; the number of buckets grows with the
input, so that each holds a bounded number of bytes.

Defined cases: a null text is empty; null doc_ids are later than all others, which are below 2**63 - 2**40; rows with one doc_id, or
with none, don't match each other, whatever their texts; texts under LEAST bytes stay whole; an empty table gives no rows. Ties need no order: only the smallest doc_id counts.
Other columns are kept by remove_repeats() and not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from basinflow.session import ship

LEAST, ANCHOR = 50, 20
SPAN = LEAST - ANCHOR + 1
#: Windows of one segment of a text, and bytes scanned at once; places fit PLACE_BITS bits.
SEGMENT, SCAN, PLACE_BITS = 1 << 20, 1 << 20, 22
#: Text bytes for each bucket, and bytes that a task holds before it sends entries.
BUCKET_BYTES, HOLD_BYTES = 8 << 20, 32 << 20
LEAST_BUCKETS = 8
#: Ids that stand for null begin here, one for each text; they count as one doc_id.
NULLS, NULL_TEXTS = (1 << 63) - (1 << 40), (1 << 40) - 1
#: Strings of a batch, and suffixes of a level that are scanned at a time.
INDEX_BATCH, BLOCK = 4096, 1 << 16
PLACE = (1 << PLACE_BITS) - 1
#: Odd multipliers that mix the bytes of an anchor.
MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def _eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as one integer."""
    n = len(data) - 7
    out = np.empty(n, np.uint64)
    for shift in range(8):
        some = (n - shift + 7) // 8
        if some > 0:
            out[shift::8] = data[shift : shift + 8 * some].view("<u8")
    return out


def anchored_runs(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(piece, start, windows, anchor) of each run of windows with one anchor; the pieces hold at most SCAN + SEGMENT bytes."""
    lengths = np.array([len(p) for p in pieces], np.int64)
    windows = np.maximum(lengths - LEAST + 1, 0)
    if not windows.sum():
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    data = np.frombuffer(b"".join(pieces) + bytes(16), np.uint8)
    eights = _eights(data)
    n = len(data) - 16 - ANCHOR + 1
    h = eights[:n] * MIX[0]
    h ^= h >> np.uint64(31)
    h += eights[8 : n + 8] * MIX[1]
    h *= MIX[2]
    h ^= h >> np.uint64(29)
    h += eights[ANCHOR - 8 : n + ANCHOR - 8] * MIX[3]
    h *= MIX[4]
    h ^= h >> np.uint64(32)
    least = (h & np.uint64(~PLACE & (1 << 64) - 1)) | np.arange(n, dtype=np.uint64)
    width = 1
    while 2 * width <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < SPAN:
        least = np.minimum(least[: -(SPAN - width)], least[SPAN - width :])
    begins = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    owner = np.repeat(np.arange(len(pieces)), windows)
    first = np.concatenate(([0], np.cumsum(windows)[:-1]))
    inside = np.arange(len(owner)) - first[owner]
    chosen = least[begins[owner] + inside]
    cut = np.flatnonzero(np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1]))))
    return owner[cut], inside[cut], np.diff(np.append(cut, len(chosen))), h[(chosen[cut] & np.uint64(PLACE)).astype(np.int64)]


def text_runs(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, start, windows, anchor) in blocks; long texts are cut into overlapping segments."""
    held, owners, offsets, size = [], [], [], 0

    def scan():
        piece, start, windows, anchor = anchored_runs(held)
        return np.array(owners, np.int64)[piece], start + np.array(offsets, np.int64)[piece], windows, anchor

    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text) - LEAST + 1), SEGMENT):
            piece = text[at : at + SEGMENT + LEAST - 1]
            if len(piece) < LEAST:
                continue
            held.append(piece)
            owners.append(k)
            offsets.append(at)
            size += len(piece)
            if size >= SCAN:
                yield scan()
                held, owners, offsets, size = [], [], [], 0
    if held:
        yield scan()


def suffixes(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The LEAST bytes from each place on; a last byte other than zero keeps trailing zero bytes."""
    keys = np.ones((len(places), LEAST + 1), np.uint8)
    keys[:, :LEAST] = np.lib.stride_tricks.sliding_window_view(data, LEAST)[places]
    return keys.view(f"S{LEAST + 1}").ravel()


class SuffixLevels:
    """Suffix arrays over the bytes of batches, in levels of geometric sizes: (bytes, places in lexical order, smallest docs).
    Suffixes are told apart to LEAST bytes, and equal ones have one place."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    @staticmethod
    def _scan(level: tuple[np.ndarray, np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where sorted suffixes stand among those of a level, and whether the level has them; both are passed once, in blocks."""
        data, places, _ = level
        at, same, done = np.full(len(keys), len(places), np.int64), np.zeros(len(keys), bool), 0
        for begin in range(0, len(places), BLOCK):
            if done == len(keys):
                break
            block = suffixes(data, places[begin : begin + BLOCK])
            upto = int(np.searchsorted(keys, block[-1], side="right"))
            found = np.searchsorted(block, keys[done:upto])
            at[done:upto], same[done:upto] = begin + found, block[found] == keys[done:upto]
            done = upto
        return at, same

    def _merged(self, old, new):
        data, places, docs = old
        at, same = self._scan(old, suffixes(new[0], new[1]))
        docs = docs.copy()
        docs[at[same]] = np.minimum(docs[at[same]], new[2][same])
        return np.concatenate((data, new[0])), np.insert(places, at[~same], new[1][~same] + len(data)), np.insert(docs, at[~same], new[2][~same])

    def add(self, strings: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(string, hit) for each window of the strings, in their order: whether it is in a smaller doc of this batch or an
        earlier one; the batch becomes a level."""
        lengths = np.array([len(s) for s in strings], np.int64)
        windows = lengths - LEAST + 1
        owner = np.repeat(np.arange(len(strings)), windows)
        first = np.concatenate(([0], np.cumsum(windows)[:-1]))
        places = (np.cumsum(lengths) - lengths)[owner] + np.arange(len(owner)) - first[owner]
        data = np.frombuffer(b"".join(strings), np.uint8)
        keys = suffixes(data, places)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        new = np.concatenate(([True], keys[1:] != keys[:-1]))
        group = np.empty(len(keys), np.int64)
        group[order] = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        keys, smallest = keys[starts], np.minimum.reduceat(docs[owner][order], starts)
        known = smallest.copy()
        for level in self.levels:
            at, same = self._scan(level, keys)
            known[same] = np.minimum(known[same], level[2][at[same]])
        made = (data, places[order][starts], smallest)
        while self.levels and len(self.levels[-1][1]) <= 2 * len(made[1]):
            made = self._merged(self.levels.pop(), made)
        self.levels.append(made)
        return owner, known[group] < docs[owner]


# Rows that move: a bucket, what they are, and packed arrays.
ENTRY, SETTLED = 0, 1
MOVED = "bucket int, kind int, docs binary, anchors binary, starts binary, lengths binary, marks binary, strings binary"
FIELDS = [part.split()[0] for part in MOVED.split(", ")]
TYPES = pa.schema([(n, pa.int32() if k < 2 else pa.binary()) for k, n in enumerate(FIELDS)])
KINDS = {"docs": np.int64, "anchors": np.uint64, "starts": np.uint32, "lengths": np.uint32, "marks": np.int32}


def _pack(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True) if raw else b""


def _unpack(packed: bytes) -> bytes:
    return pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True) if packed else b""


def _row(bucket: int, kind: int, strings: bytes = b"", **arrays) -> dict:
    """docs go as differences: in order, they are small."""
    out = {"bucket": bucket, "kind": kind, "strings": _pack(strings)}
    for name, kept in KINDS.items():
        values = np.asarray(arrays.get(name, ()), kept)
        out[name] = _pack((np.diff(values, prepend=0) if name == "docs" else values).tobytes())
    return out


def _column(table: pa.Table, name: str) -> np.ndarray:
    parts = [np.frombuffer(_unpack(x.as_py()), KINDS[name]) for x in table.column(name)]
    parts = [np.cumsum(p) for p in parts] if name == "docs" else parts
    return np.concatenate(parts) if parts else np.empty(0, KINDS[name])


def _of_kind(table: pa.Table, kind: int) -> pa.Table:
    return table.filter(pa.compute.equal(table.column("kind"), kind))


def _split(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(key, indices) of equal keys."""
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.diff(keys[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(keys[part[0]]), part


def _text_marks(ids: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Tells different texts apart that share a doc_id, by their order; 0 for a doc_id that has one. Its rows share a home."""
    marks = np.zeros(len(ids), np.int32)
    order = np.argsort(ids, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(ids[order])) + 1):
        if len(rows) > 1:
            rank = {text: k for k, text in enumerate(sorted({texts[i] for i in rows}))}
            marks[rows] = [rank[texts[i]] for i in rows]
    return marks


def _ids(table) -> np.ndarray:
    return table.column("id").to_numpy(zero_copy_only=False).astype(np.int64)


def _order(ids: np.ndarray) -> np.ndarray:
    """Ids as they are compared: those that stand for null are one."""
    return np.minimum(ids, NULLS)


def _texts(table) -> list[bytes]:
    return [(t.as_py() or "").encode() for t in table.column("text")]


def _anchor_entries(buckets: int):
    """Step 1, before the shuffle: anchors with the smallest of the held documents that have them; those that two have are settled."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        held = 0

        def send() -> pa.RecordBatch:
            anchors, docs = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((docs, anchors))
            anchors, docs = anchors[order], docs[order]
            keep = np.concatenate(([True], (anchors[1:] != anchors[:-1]) | (docs[1:] != docs[:-1])))
            anchors, docs = anchors[keep], docs[keep]
            cut = np.flatnonzero(np.concatenate(([True], anchors[1:] != anchors[:-1])))
            counts = np.diff(np.append(cut, len(anchors)))
            cut = cut[np.argsort(docs[cut], kind="stable")]
            many = np.zeros(len(anchors), bool)
            many[np.repeat(np.sort(cut), counts)[np.repeat(counts > 1, counts)]] = True
            out = []
            for bucket, part in _split((anchors[cut] % np.uint64(buckets)).astype(np.int64)):
                at = cut[part]
                out.append(_row(bucket, ENTRY, docs=docs[at], anchors=anchors[at], marks=many[at]))
            shared = np.flatnonzero(np.repeat(counts > 1, counts))
            shared = shared[np.argsort(docs[shared], kind="stable")]
            for home, part in _split(docs[shared] % buckets):
                out.append(_row(home, SETTLED, docs=docs[shared][part], anchors=anchors[shared][part]))
            return pa.RecordBatch.from_pylist(out, TYPES)

        for batch in batches:
            texts, ids = _texts(batch), _ids(batch)
            for text, _, _, anchor in text_runs(texts):
                found.append((anchor, ids[text]))
            held += sum(map(len, texts))
            if held >= HOLD_BYTES and found:
                yield send()
                found, held = [], 0
        if found:
            yield send()

    return rows


def _shared_anchors(buckets: int):
    """Step 1, one bucket: (doc, anchor) pairs whose anchor another document has."""

    def rows(table: pa.Table) -> pa.Table:
        settled, entries = _of_kind(table, SETTLED), _of_kind(table, ENTRY)
        parts = [(_column(settled, "docs"), _column(settled, "anchors"))]
        anchors, docs, many = (_column(entries, n) for n in ("anchors", "docs", "marks"))
        if len(anchors):
            order = np.argsort(anchors, kind="stable")
            anchors, docs, many = anchors[order], docs[order], many[order]
            cut = np.flatnonzero(np.concatenate(([True], anchors[1:] != anchors[:-1])))
            counts = np.diff(np.append(cut, len(anchors)))
            differ = (np.minimum.reduceat(docs, cut) != np.maximum.reduceat(docs, cut)) | (np.maximum.reduceat(many, cut) > 0)
            wanted = np.repeat(differ, counts) & (many == 0)
            parts.append((docs[wanted], anchors[wanted]))
        docs, anchors = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(docs, kind="stable")
        docs, anchors = docs[order], anchors[order]
        return pa.Table.from_pylist([_row(home, SETTLED, docs=docs[p], anchors=anchors[p]) for home, p in _split(docs % buckets)], TYPES)

    return rows


def _pair_hash(docs: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    return anchors ^ (docs.astype(np.uint64) * MIX[0])


def _run_entries(buckets: int):
    """Step 2, before the shuffle: the runs of shared anchors of one home's documents; equal runs are settled here."""

    def rows(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return TYPES.empty_table()
        home = key[0].as_py()
        left = left.sort_by("id")
        texts, ids = _texts(left), _ids(left)
        marks, ranks = _text_marks(ids, texts), _order(ids)
        shared = np.unique(_pair_hash(_column(right, "docs"), _column(right, "anchors")))
        first: dict[bytes, list] = {}
        covered: list[tuple] = []
        for text, start, windows, anchor in text_runs(texts):
            some = np.flatnonzero(np.isin(_pair_hash(ids[text], anchor), shared))
            ends = start[some] + windows[some] + LEAST - 1
            for t, a, b, m in zip(text[some].tolist(), start[some].tolist(), ends.tolist(), anchor[some].tolist()):
                string = texts[t][a:b]
                seen = first.setdefault(string, [m])
                if len(seen) > 1 and ranks[seen[1][0]] < ranks[t]:
                    covered.append((t, a, b))
                else:
                    seen.append((t, a))
        entries = [(s, seen[0], t, a) for s, seen in first.items() for t, a in seen[1:]]
        out = []
        if entries:
            anchors = np.array([e[1] for e in entries], np.uint64)
            owner = np.array([e[2] for e in entries])
            starts = np.array([e[3] for e in entries])
            for bucket, part in _split((anchors % np.uint64(buckets)).astype(np.int64)):
                part = part[np.argsort(owner[part], kind="stable")]
                strings = [entries[i][0] for i in part]
                at = owner[part]
                # Within a bucket the low bits tell anchors apart; two that they don't are only compared in vain.
                low = anchors[part] & np.uint64(0xFFFFFFFF)
                out.append(_row(bucket, ENTRY, b"".join(strings), docs=ids[at], anchors=low, starts=starts[part], lengths=[len(s) for s in strings], marks=marks[at]))
        if covered:
            owner, starts, ends = (np.array(x) for x in zip(*covered))
            out.append(_row(home, SETTLED, docs=ids[owner], starts=starts, lengths=ends - starts, marks=marks[owner]))
        return pa.Table.from_pylist(out, TYPES)

    return rows


def _covered_ranges(table: pa.Table, buckets: int) -> pa.Table:
    """Step 2, one bucket: the ranges of documents that smaller documents hold too."""
    settled, entries = _of_kind(table, SETTLED), _of_kind(table, ENTRY)
    parts = [tuple(_column(settled, n) for n in ("docs", "starts", "lengths", "marks"))]
    docs, anchors, starts, lengths, marks = (_column(entries, n) for n in ("docs", "anchors", "starts", "lengths", "marks"))
    if len(docs):
        buffer = b"".join(_unpack(x.as_py()) for x in entries.column("strings"))
        places = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64))).tolist()
        order, ranks = np.argsort(docs, kind="stable"), _order(docs)
        first: dict[bytes, list[int]] = {}
        equal: list[int] = []
        for i in order.tolist():
            seen = first.setdefault(buffer[places[i] : places[i + 1]], [])
            if seen and ranks[seen[0]] < ranks[i]:
                equal.append(i)
            else:
                seen.append(i)
        parts.append((docs[equal], starts[equal], lengths[equal], marks[equal]))
        # Runs that are alone with their anchor, or whose anchor only one document has here, match nothing.
        strings = list(first)
        lead = np.array([first[s][0] for s in strings])
        rank = np.argsort(anchors[lead], kind="stable")
        cut = np.flatnonzero(np.concatenate(([True], np.diff(anchors[lead][rank]) != 0)))
        counts = np.diff(np.append(cut, len(rank)))
        of = docs[lead][rank]
        differ = np.minimum.reduceat(of, cut) != np.maximum.reduceat(of, cut)
        wanted = np.sort(rank[np.repeat(differ, counts)])  # strings are in order of their smallest doc
        index = SuffixLevels()
        for at in range(0, len(wanted), INDEX_BATCH):
            batch = wanted[at : at + INDEX_BATCH]
            owner, hit = index.add([strings[i] for i in batch], ranks[lead[batch]])
            begin = np.searchsorted(owner, np.arange(len(batch)))
            # Runs of covered windows make one range.
            hits = np.flatnonzero(hit)
            fresh = np.concatenate(([True], (np.diff(hits) != 1) | (np.diff(owner[hits]) != 0))) if len(hits) else np.empty(0, bool)
            for a, b in zip(hits[fresh].tolist(), np.append(hits[np.roll(fresh, -1)], []).astype(int).tolist()):
                k = owner[a]
                for i in first[strings[batch[k]]]:
                    parts.append(((docs[i],), (int(starts[i]) + a - begin[k],), (b - a + LEAST,), (marks[i],)))
    docs, starts, lengths, marks = (np.concatenate([np.asarray(x) for x in c]).astype(np.int64) for c in zip(*parts))
    order = np.argsort(docs, kind="stable")
    docs, starts, lengths, marks = docs[order], starts[order], lengths[order], marks[order]
    return pa.Table.from_pylist([_row(home, SETTLED, docs=docs[p], starts=starts[p], lengths=lengths[p], marks=marks[p]) for home, p in _split(docs % buckets)], TYPES)


def _removals(left: pa.Table, right: pa.Table) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """Step 3, one home: (row, text, removed bytes)."""
    docs, starts, lengths, marks = (_column(right, n) for n in ("docs", "starts", "lengths", "marks"))
    order = np.argsort(docs, kind="stable")
    docs, starts, marks = docs[order], starts[order].astype(np.int64), marks[order]
    ends = starts + lengths[order]
    texts, ids = _texts(left), _ids(left)
    own = _text_marks(ids, texts)
    low, high = np.searchsorted(docs, ids, "left"), np.searchsorted(docs, ids, "right")
    for k, text in enumerate(texts):
        removed = np.zeros(len(text) + 1, np.int32)
        at = slice(low[k], high[k])
        mine = marks[at] == own[k]
        np.add.at(removed, starts[at][mine], 1)
        np.add.at(removed, ends[at][mine], -1)
        yield k, text, np.cumsum(removed[:-1]) > 0


def _kept(text: bytes, removed: np.ndarray) -> bytes:
    return np.frombuffer(text, np.uint8)[~removed].tobytes() if removed.any() else text


def _digests(left: pa.Table, right: pa.Table) -> pa.Table:
    n_bytes, n_removed, n_spans, digest = [], [], [], []
    for _, text, removed in _removals(left, right):
        n_bytes.append(len(text))
        n_removed.append(int(removed.sum()))
        n_spans.append(int(np.count_nonzero(removed[1:] & ~removed[:-1]) + (len(removed) > 0 and bool(removed[0]))))
        digest.append(hashlib.sha256(_kept(text, removed)).hexdigest())
    ids = pa.array([i if i < NULLS else None for i in _ids(left).tolist()], pa.int64())
    return pa.table({"doc_id": ids, "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept_sha256": pa.array(digest, pa.string())})


def _cleaned(left: pa.Table, right: pa.Table) -> pa.Table:
    texts = [None] * left.num_rows
    for k, text, removed in _removals(left, right):
        if left.column("text")[k].is_valid:
            texts[k] = _kept(text, removed).decode("utf-8", "ignore")
    return pa.table({"text": pa.array(texts, pa.string()), "row": left.column("row")})


def _covered(docs: DataFrame, row: Column) -> tuple:
    """The documents as id, home, text and row, the covered ranges, each dealt by home. Tasks grow in number with the
    homes, each of about BUCKET_BYTES, and not in size."""
    ship(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = next(n for n in count(max(LEAST_BUCKETS, -(-size // BUCKET_BYTES))) if all(n % k for k in range(2, int(n**0.5) + 1)))
    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULLS) + F.pmod(F.xxhash64("text"), F.lit(NULL_TEXTS)))
    homed = docs.select(ids.alias("id"), F.pmod(ids, F.lit(buckets)).cast("int").alias("home"), "text", row.alias("row"))
    dealt = lambda df, by: df.repartition(buckets, by).groupBy(by)
    anchors = homed.select("id", "text").mapInArrow(_anchor_entries(buckets), MOVED)
    shared = dealt(anchors, "bucket").applyInArrow(_shared_anchors(buckets), MOVED)
    runs = dealt(homed, "home").cogroup(dealt(shared, "bucket")).applyInArrow(_run_entries(buckets), MOVED)
    ranges = dealt(runs, "bucket").applyInArrow(lambda table: _covered_ranges(table, buckets), MOVED)
    return dealt(homed, "home"), dealt(ranges, "bucket")


def repeat_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every whole text."""
    homed, ranges = _covered(docs, F.lit(0))
    return homed.cogroup(ranges).applyInArrow(_digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """All columns, the covered bytes gone from text; characters that a cut leaves incomplete go too."""
    others = F.struct(*[c for c in docs.columns if c != "text"])
    homed, ranges = _covered(docs, others)
    schema = StructType([StructField("text", StringType()), StructField("row", docs.select(others.alias("row")).schema["row"].dataType)])
    cleaned = homed.cogroup(ranges).applyInArrow(_cleaned, schema)
    return cleaned.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def op6_suffix_dedup(spark, sf_dir):
    from basinflow.llm.common import table

    return repeat_digests(table(spark, sf_dir, "documents"))
