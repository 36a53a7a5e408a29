"""BPE encoding with bounded lookahead, and decoding with an incremental state machine.

The merge list fixes how far to the right of a token the bytes can reach that decide it: a merge is only prevented by an earlier
merge of its last part with what follows, which in turn is only prevented by a still earlier one. The longest such chain is
computed once; while a word is read, tokens further from its end than that are final and leave the buffer. A text is read in
portions that end at white space, and its ids go on to the hash and the decoder as they come. What is held is a portion, or one
piece between white space where that is longer, and two generations of remembered words and pieces of a fixed size.

Defined cases: a null text encodes as empty; repeated rows get equal rows; a null doc_id is carried along; an empty text has no
tokens. Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame

from basinflow.llm.common import by_text, give_back

TOKENIZER = "word_bpe_49k.json"
WORD_END = "</w>"
#: White space of the normaliser, by code point (the property White_Space).
SPACE = r"\t-\r\x20\x85\xa0  -     　"

#: Pieces and words of up to so many bytes are remembered, so many at most in each of two generations; what is read at once.
MEMO_BYTES, MEMO_PIECES, PORTION = 32, 1 << 18, 1 << 16
SHORT_BYTES, NONE = 32, 1 << 40


#: Contractions, runs of letters, single digits, runs of the rest.
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+")


#: The same for lower-case ASCII.
PLAIN = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
SPACE_BYTES = re.compile(r"[\t-\r ]")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def packed(ids: Iterable[int]) -> bytes:
    return array("I", ids).tobytes()


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if printable in Latin-1, else the next free one from 256 up."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class StreamingBpe:
    """Encoder and decoder of a merge list whose words end in a suffix."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max(*self.vocab.values(), *self.special.values())
        self.strings = [""] * size
        for token, number in chain(self.vocab.items(), self.special.items()):
            self.strings[number] = token
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        self.letters = byte_letters()
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, (left, right) in enumerate(model["merges"]):
            a, b, whole = self.vocab[left], self.vocab[right], self.vocab[left + right]
            self.merges.setdefault((a, b), (rank, whole))
            self.parts.setdefault(whole, (a, b))
        self.inner = [self.vocab[x] for x in self.letters]
        self.last = [self.vocab[x + WORD_END] for x in self.letters]
        self.lookahead = self._sufficient_lookahead()
        self.ranks = {(a << 16) | b: rank for (a, b), (rank, _) in self.merges.items()}
        self.results = {rank: whole for rank, whole in self.merges.values()}
        self.memo, self.older = {}, {}
        self.path, self.library = path, None

    def forget(self) -> None:
        """Drop what is remembered: between tasks it would only take the place of other work's memory."""
        self.memo, self.older = {}, {}
        give_back()

    def _sufficient_lookahead(self) -> int:
        """Bytes to the right of a token that can decide it, over all chains of earlier merges that could take its last part."""
        size = [len(s.removesuffix(WORD_END)) for s in self.strings]
        reach: dict[int, int] = {}
        most = 0
        for (left, right), (_, whole) in sorted(self.merges.items(), key=lambda x: x[1][0]):
            far, part = reach.get(right, 0), right
            while part in self.parts:
                part = self.parts[part][1]
                far = max(far, reach.get(part, 0))
            most = max(most, far + size[right])
            reach[left] = max(reach.get(left, 0), far + size[right])
        return most + max(size)

    def _merge(self, symbols: list[int]) -> list[int]:
        """All merges, lowest rank first and leftmost among equals, by a heap over a linked list."""
        n = len(symbols)
        if n < 2:
            return symbols
        merges, after, before = self.merges, list(range(1, n + 1)), list(range(-1, n - 1))
        symbols = list(symbols)
        heap = [(m[0], i, symbols[i], symbols[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((symbols[i], symbols[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, whole = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = whole, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := merges.get((whole, symbols[k])):
                    heapq.heappush(heap, (m[0], i, whole, symbols[k], m[1]))
            if (h := before[i]) >= 0 and (m := merges.get((symbols[h], whole))):
                heapq.heappush(heap, (m[0], h, symbols[h], whole, m[1]))
        return [s for s in symbols if s >= 0]

    def word(self, data: bytes) -> Iterator[int]:
        """Tokens of one word, emitted once no later byte can change them."""
        window, at, n = 4 * self.lookahead, 0, len(data)
        while n - at > window:
            stable, taken = 0, at
            for token in self._merge([self.inner[b] for b in data[at : at + window]]):
                stable += len(self.strings[token])
                if stable > window - self.lookahead:
                    break
                yield token
                taken = at + stable
            at = taken
        if n > at:
            yield from self._merge([*(self.inner[b] for b in data[at : n - 1]), self.last[data[n - 1]]])

    def piece(self, raw: bytes) -> bytes:
        """Tokens, four bytes each, of what stands between white space."""
        ids = self.older.get(raw)
        if ids is None:
            words = [raw.lower()] if raw.isalpha() else PLAIN.findall(raw.lower()) if raw.isascii() else self.split(raw.decode())
            ids = self.tokens(raw) if words == [raw] else b"".join(map(self.part, words))
        self._remember(raw, ids)
        return ids

    def part(self, word: bytes) -> bytes:
        """Tokens of one word of a piece. An ASCII word as a piece is cut no further; others are normalised already, and must not be
        again, so they have keys of their own: no text has the byte 255."""
        if word.isascii():
            return self.memo.get(word) or self.piece(word)
        key = b"\xff" + word
        ids = self.memo.get(key)
        if ids is None:
            ids = self.older.get(key) or self.tokens(word)
            self._remember(key, ids)
        return ids

    def _remember(self, key: bytes, ids: bytes) -> None:
        if len(key) <= MEMO_BYTES:
            if len(self.memo) >= MEMO_PIECES:
                self.older, self.memo = self.memo, {}
            self.memo[key] = ids

    def split(self, plain: str) -> list[bytes]:
        """Words of a piece: normalised to composed lower case, split by kind of character."""
        if "Cn" in map(unicodedata.category, plain):
            return self.newest_words(plain)
        return [word.encode() for word in WORD.findall(unicodedata.normalize("NFC", plain).replace("Σ", "σ").lower())]

    def newest_words(self, plain: str) -> list[bytes]:
        """Words of a piece with code points that Python's tables don't know: the tokenizers library has tables of its own."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        text = self.library.normalizer.normalize_str(plain)
        number = {letter: k for k, letter in enumerate(self.letters)}
        return [bytes(map(number.__getitem__, word)) for word, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def tokens(self, word: bytes) -> bytes:
        """Tokens of one word; short ones by scanning, long ones in a stream."""
        if len(word) <= SHORT_BYTES:
            return packed(self._merge_short([*map(self.inner.__getitem__, word[:-1]), self.last[word[-1]]]))
        return packed(self.word(word))

    def _merge_short(self, symbols: list[int]) -> list[int]:
        """As _merge, by looking for the lowest rank anew each time; equal ranks are equal pairs, taken from the left."""
        get, none = self.ranks.get, NONE
        ranks = [get((a << 16) | b, none) for a, b in zip(symbols, symbols[1:])]
        while ranks:
            least = min(ranks)
            if least == none:
                break
            i = ranks.index(least)
            symbols[i] = self.results[least]
            del symbols[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get((symbols[i] << 16) | symbols[i + 1], none)
            if i:
                ranks[i - 1] = get((symbols[i - 1] << 16) | symbols[i], none)
        return symbols

    def stream(self, text: str | None) -> Iterator[np.ndarray]:
        """The ids of a whole text as unsigned 32-bit integers, portion by portion."""
        text, at = text or "", 0
        for match in [*(self.special_pattern.finditer(text) if "<|" in text else ()), None]:
            upto = match.start() if match else len(text)
            while at < upto:
                cut = SPACE_BYTES.search(text, min(at + PORTION, upto), upto)
                end = cut.end() if cut else upto
                raws = text[at:end].encode().split()
                known = list(map(self.memo.get, raws))
                if None in known:
                    known = [ids or self.piece(raw) for ids, raw in zip(known, raws)]
                yield np.frombuffer(b"".join(known), np.uint32)
                at = end
            if match:
                yield np.array([self.special[match[0]]], np.uint32)
                at = match.end()

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a whole text at once."""
        parts = list(self.stream(text))
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.uint32)


class Decoder:
    """Feeds ids to text in any portions. The state is one flag: whether a token was written before.

    This vocabulary has no decoder of its own, so the text of ids is their tokens, in letters that stand for bytes, with spaces
    between. With plain=True the letters become bytes again and word ends spaces; a character cut between tokens waits.
    """

    def __init__(self, bpe: StreamingBpe, plain: bool = False) -> None:
        import codecs

        self.strings, self.plain, self.begun = bpe.strings, plain, False
        self.bytes = {letter: number for number, letter in enumerate(bpe.letters)}
        self.special = set(bpe.special.values())
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        ids = list(ids)
        if self.plain:
            out = []
            for i in ids:
                token = self.strings[i]
                end = token.endswith(WORD_END)
                raw = token.encode() if i in self.special else bytes(self.bytes[c] for c in token.removesuffix(WORD_END))
                out.append(self.utf8.decode(raw) + " " * end)
            return "".join(out)
        if not ids:
            return ""
        text = " ".join(map(self.strings.__getitem__, ids))
        begun, self.begun = self.begun, True
        return f" {text}" if begun else text

    def finish(self) -> str:
        return self.utf8.decode(b"", final=True) if self.plain else ""


@lru_cache(maxsize=2)
def load(path: str) -> StreamingBpe:
    """One encoder for each Python worker."""
    return StreamingBpe(path)


def round_trip_digests(docs: DataFrame, name: str = TOKENIZER) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text; one pass, no shuffle."""

    def prepare():
        bpe = load(tokenizer_path(name))

        def digests(text: str | None) -> tuple:
            decoder, of_ids, of_text, n = Decoder(bpe), hashlib.sha256(), hashlib.sha256(), 0
            for ids in bpe.stream(text):
                n += len(ids)
                of_ids.update(ids.astype("<u4").tobytes())
                of_text.update(decoder.feed(ids.tolist()).encode())
            of_text.update(decoder.finish().encode())
            return n, of_ids.hexdigest(), of_text.hexdigest()

        return digests

    return by_text(docs, prepare, "n_tokens long, ids_sha256 string, decoded_sha256 string", lambda: load(tokenizer_path(name)).forget())


def op9_bpe(spark, sf_dir):
    from basinflow.llm.common import table

    return round_trip_digests(table(spark, sf_dir, "documents"))
