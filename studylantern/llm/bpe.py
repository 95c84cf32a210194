"""BPE encoding and decoding (operator 2), and cached encoding for the word vocabulary (operators 4 and 6).

Symbols of a word stand in a doubly linked list; a heap holds (rank, position) of adjacent pairs. The best pair is
merged, its neighbours' new pairs are pushed, and entries whose pair has changed meanwhile are skipped when they come
up. Words are encoded once per worker and kept in a bounded dictionary, so the heap runs on new words only.
Decoding concatenates the vocabulary's byte strings.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Entries of a worker's dictionary of words: two or three times this many stay below 200 MB.
CACHE_ENTRIES = 500_000
#: White space of the tokenizers' patterns (Unicode White_Space), and the byte-level word pattern.
SPACE = r"\t-\r \x85\xa0  -     　"
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
TOKENS_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Known(dict):
    """A bounded dictionary in two generations: when the new one is full it becomes the old one; hits move up from there."""

    def __init__(self, make, entries: int):
        super().__init__()
        self.make, self.entries, self.old = make, entries, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        return self.keep(key, value)

    def keep(self, key: str, value: bytes) -> bytes:
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class ByteBpe:
    """Byte-level BPE of a tokenizers JSON file."""

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab: dict[str, int] = spec["model"]["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        symbols = byte_symbols()
        byte_of = {s: b for b, s in enumerate(symbols)}
        self.first = [vocab[s] for s in symbols]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.strings = {i: bytes(byte_of[c] for c in s) if all(c in byte_of for c in s) else s.encode() for s, i in vocab.items()}
        self.strings |= {i: s.encode() for s, i in self.special.items()}
        self.words = regex.compile(WORDS)
        self.spaces = re.compile(f"[{SPACE}][{SPACE}]")
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known, self.chunks = Known(self.word, cache_entries // 2), Known(self.chunk, cache_entries)

    def merge(self, symbols: list[int]) -> list[int]:
        """Merge the lowest rank first, leftmost among equals, until no pair has a rank."""
        n, merges = len(symbols), self.merges
        after, before, ids = list(range(1, n + 1)), list(range(-1, n - 1)), list(symbols)
        heap = [(hit[0], i, hit[1]) for i in range(n - 1) if (hit := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            rank, i, whole = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or (hit := merges.get((ids[i], ids[j]))) is None or hit[0] != rank:
                continue  # stale: a neighbour was merged since
            ids[i], ids[j], after[i] = whole, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
                if new := merges.get((whole, ids[after[j]])):
                    heapq.heappush(heap, (new[0], i, new[1]))
            if (p := before[i]) >= 0 and (new := merges.get((ids[p], whole))):
                heapq.heappush(heap, (new[0], p, new[1]))
        return [x for x in ids if x >= 0]

    def word(self, word: str) -> bytes:
        return np.array(self.merge([self.first[b] for b in word.encode()]), "<u4").tobytes()

    def chunk(self, chunk: str) -> bytes:
        """Of a stretch that begins at a single space or the text's start and ends before a single space or the end."""
        return b"".join([self.known[w] for w in self.words.findall(chunk)])

    def plain(self, text: str) -> bytes:
        if self.spaces.search(text) or text[-1:].isspace():
            return b"".join([self.known[w] for w in self.words.findall(text)])
        head, *rest = text.split(" ")  # each space stands alone, so no word of the pattern spans two stretches
        known = self.chunks
        return (known[head] if head else b"") + b"".join([known[" " + r] for r in rest])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.at_special is None or not self.at_special.search(text):
            return self.plain(text)
        out = []
        for piece in self.at_special.split(text):
            out.append(np.array([self.special[piece]], "<u4").tobytes() if piece in self.special else self.plain(piece))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Concatenated vocabulary strings; bytes that are no UTF-8 become the replacement character."""
        return b"".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


#: Bytes of text that a word encoder takes at once, about.
ENCODE_BYTES = 4_000_000
#: Longest word that is merged here, by arrays of words; longer ones go to the library. No merge has this rank.
MERGED_CHARS, NO_RANK = 32, 2**30
#: Classes of bytes: white space, letters, digits, other signs of one word, and what makes its whole stretch a case for the library.
BLANK, LETTER, DIGIT, SIGN, HARD, STRETCH = range(6)
_CLASS = np.full(256, HARD, np.uint8)
_CLASS[33:127] = SIGN
_CLASS[[*range(65, 91), *range(97, 123)]] = LETTER
_CLASS[48:58] = DIGIT
_CLASS[[32, *range(9, 14)]] = BLANK
_CLASS[ord("'")] = HARD
#: White space beyond ASCII (Python's and the library's) as UTF-8, by its bytes.
_BLANK_2, _BLANK_3 = (
    np.array([list(c.encode()) for c in blanks], np.uint8)
    for blanks in ("\x85\xa0", "\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000")
)


class WordEncoder:
    """Ids of a tokenizers JSON file that drops white space, for many texts at once.

    No token of such a vocabulary spans white space. Texts are cut into units in array operations: words of the pattern where
    a white-space separated stretch is plain Latin (lower-cased, as the library does), whole stretches elsewhere. Each distinct
    unit of the texts is looked up once; new ones go to the library in one string.
    """

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        special = [(t["content"], t["id"]) for t in spec["added_tokens"] if t["special"]]
        vocab: dict[str, int] = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        pairs = np.array([(vocab[a] << 32) | vocab[b] for a, b in merges], np.int64)
        by_pair = np.argsort(pairs, kind="stable")
        self.pairs, self.rank = np.append(pairs[by_pair], np.iinfo(np.int64).max), np.append(by_pair, NO_RANK).astype(np.int32)
        self.whole_of = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.inner, self.final = (np.array([vocab[c + suffix] for c in byte_symbols()], np.int32) for suffix in ("", "</w>"))
        self.special = [token.encode() for token, _ in special]
        self.mark, self.mark_id = special[0]
        self.is_end = np.zeros(self.library.get_vocab_size(), bool)
        self.is_end[[i for token, i in self.library.get_vocab(with_added_tokens=False).items() if token.endswith("</w>")]] = True
        self.word = re.compile(f"[a-zß-öø-ÿ]{{1,{MERGED_CHARS}}}|[0-9]|[!-&(-/:-@[-`{{-~]{{1,{MERGED_CHARS}}}")
        self.simple = re.compile("[!-~À-ÖØ-öø-ÿ]+")
        self.words = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
        self.whole = re.compile("[\x1c-\x1f]|" + "|".join(re.escape(s) for s, _ in special))
        self.entries, self.known, self.old = cache_entries, {}, {}

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.encode_texts(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))[0].tobytes()

    def encode_texts(self, data: np.ndarray, at: np.ndarray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids (unsigned 32-bit) of the texts with bytes data[at[i] : at[i + 1]], each followed by end_id where given, and the n + 1 bounds between them."""
        units, bounds, odd = self.units(data, at)
        coded = units.dictionary_encode()
        which = coded.indices.to_numpy()
        ids = self.lookup(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), odd)
        _, offsets, data = pa.array(ids, pa.large_binary()).take(coded.indices).buffers()
        out = np.frombuffer(data, "<u4") if data is not None else np.zeros(0, "<u4")
        bounds = (np.frombuffer(offsets, np.int64)[: len(which) + 1] >> 2).take(bounds) if len(which) else np.zeros(len(bounds), np.int64)
        if end_id is None:
            return out, bounds
        ended = np.empty(len(out) + len(bounds) - 1, "<u4")
        at = bounds[1:] + np.arange(len(bounds) - 1)
        inside = np.ones(len(ended), bool)
        inside[at] = False
        ended[inside], ended[at] = out, end_id
        return ended, bounds + np.arange(len(bounds))

    def units(self, data: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray, bool]:
        """The units of texts, for each text its range of them, and whether any is a whole text.

        A text with a special token, or with separators on which Python and the library differ, is one unit.
        """
        kind = _CLASS[data]
        odd = [np.flatnonzero((data >= 0x1C) & (data <= 0x1F))]
        raw = data.tobytes()
        for token in self.special:
            place, found = raw.find(token), []
            while place >= 0:
                found.append(place)
                place = raw.find(token, place + 1)
            odd.append(np.array(found, np.int64))
        hard = latin = np.flatnonzero(kind == HARD)
        if len(hard):
            for blanks in (_BLANK_2, _BLANK_3):
                n = blanks.shape[1]
                lead = hard[np.isin(data[hard], blanks[:, 0], kind="table")]
                lead = lead[lead + n <= len(data)]
                lead = lead[(data[lead[:, None] + np.arange(n)][:, None, :] == blanks).all(axis=2).any(axis=1)]
                for k in range(n):
                    kind[lead + k] = BLANK
            latin = hard[(data[hard] == 0xC3) & (hard + 1 < len(data))]  # letters from À to ÿ
            latin = latin[(data[latin + 1] != 0x97) & (data[latin + 1] != 0xB7)]
            kind[latin] = kind[latin + 1] = LETTER
            hard = hard[kind[hard] == HARD]
        first = np.zeros(len(data) + 1, bool)
        first[at] = True
        first = first[:-1]
        if len(hard):
            blank = kind == BLANK
            begin = np.flatnonzero(~blank & (first | np.concatenate(([True], blank[:-1]))))
            stop = np.append(begin[1:], len(data))
            mine = np.zeros(len(begin), bool)
            mine[np.searchsorted(begin, hard, side="right") - 1] = True
            kind[begin[0] :][np.repeat(mine, stop - begin) & ~blank[begin[0] :]] = STRETCH
        whole = np.unique(np.searchsorted(at, np.concatenate(odd), side="right") - 1).tolist()
        for row in whole:
            kind[at[row] : at[row + 1]] = STRETCH
        start = (kind == DIGIT) | first
        start[1:] |= kind[1:] != kind[:-1]
        solid = kind != BLANK
        start &= solid
        lowered = data | (((kind == LETTER) & (data < 0x80)).view(np.uint8) << 5)
        if len(latin):
            latin = latin[(kind[latin] == LETTER) & (data[latin + 1] < 0x9F)] + 1
            lowered[latin] |= 0x20
        place = np.flatnonzero(start[solid])
        lowered = lowered[solid]
        offsets = np.append(place, len(lowered)).astype(np.int64)
        units = pa.LargeStringArray.from_buffers(len(place), pa.py_buffer(offsets), pa.py_buffer(lowered))
        return units, np.searchsorted(np.flatnonzero(start), at), bool(whole)

    def lookup(self, units: list[str], odd: bool) -> list[bytes]:
        """Ids of each of the distinct units; odd: some are whole texts, which are not kept."""
        ids = list(map(self.known.get, units))
        missed = [k for k, i in enumerate(ids) if i is None]
        if not missed:
            return ids
        names = [units[k] for k in missed]
        again = list(map(self.old.get, names))
        if None in again:
            new, single = [u for u, i in zip(names, again, strict=True) if i is None], {}
            if odd:
                single = {u: np.array(self.library.encode(u, add_special_tokens=False).ids, "<u4").tobytes() for u in filter(self.whole.search, new)}
                new = [u for u in new if u not in single]
            coded = self.fresh(new) | single
            again = [coded[u] if i is None else i for u, i in zip(names, again, strict=True)]
        for k, i in zip(missed, again, strict=True):
            ids[k] = i
        if len(self.known) + len(missed) > self.entries:
            self.old, self.known = self.known, {}
        self.known.update(zip(names, again, strict=True) if not odd else ((u, i) for u, i in zip(names, again, strict=True) if not self.whole.search(u)))
        return ids

    def fresh(self, units: list[str]) -> dict[str, bytes]:
        """Encode new units: words by the merges, other Latin stretches by words of the pattern, the rest parted by a mark."""
        short = list(filter(self.word.fullmatch, units))
        out = dict(zip(short, self.merged(short), strict=True))
        units = [u for u in units if u not in out]
        simple = {u: self.words.findall(u.lower()) for u in units if self.simple.fullmatch(u)}
        if new := list({w for words in simple.values() for w in words}):
            (coded,) = self.library.encode_batch_fast([" ".join(new)], add_special_tokens=False)
            ids = np.array(coded.ids, "<u4")
            cuts = [0, *(4 * np.flatnonzero(self.is_end[ids]) + 4).tolist()]
            raw = ids.tobytes()
            coded = {w: raw[a:b] for w, a, b in zip(new, cuts, cuts[1:], strict=False)}
            out |= {u: b"".join([coded[w] for w in words]) for u, words in simple.items()}
        if rest := [u for u in units if u not in out]:
            ids = np.array(self.library.encode(self.mark.join(rest), add_special_tokens=False).ids, "<u4")
            cuts = np.flatnonzero(ids == self.mark_id).tolist()
            out |= {u: ids[a:b].tobytes() for u, a, b in zip(rest, [0, *(c + 1 for c in cuts)], [*cuts, len(ids)], strict=True)}
        return out

    def merged(self, words: list[str]) -> list[bytes]:
        """Ids of words of the pattern in lower case, all words of about one length at a time."""
        out, words = [b""] * len(words), [w.encode() for w in words]
        size = np.fromiter(map(len, words), np.int64, len(words))
        for least, most in zip((0, 4, 8, 12, 16, 24), (4, 8, 12, 16, 24, 2 * MERGED_CHARS), strict=True):
            for at in np.array_split(chosen := np.flatnonzero((size > least) & (size <= most)), -(-len(chosen) // 20_000) or 1):
                if not len(at):
                    continue
                n = size[at]
                letters = np.frombuffer(b"".join([words[i] for i in at.tolist()]), np.uint8)
                inside = np.arange(most) < n[:, None]
                symbols = np.full((len(at), most), -1, np.int32)
                symbols[inside] = self.inner[letters]
                symbols[np.arange(len(at)), n - 1] = self.final[letters[np.cumsum(n) - 1]]
                ids = self.merge_rows(symbols)
                cuts = np.concatenate(([0], np.cumsum(4 * (ids >= 0).sum(axis=1)))).tolist()
                raw = ids[ids >= 0].astype("<u4").tobytes()
                for i, a, b in zip(at.tolist(), cuts, cuts[1:], strict=False):
                    out[i] = raw[a:b]
        return out

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = (left.astype(np.int64) << 32) | right
        at = np.searchsorted(self.pairs, pair)
        return np.where((self.pairs[at] == pair) & (right >= 0), self.rank[at], NO_RANK)

    def merge_rows(self, symbols: np.ndarray) -> np.ndarray:
        """In each row, merge the pair of the lowest rank, leftmost among equals, until no pair has a rank. Rows end in -1s, also in the result."""
        out, row = np.full(symbols.shape, -1, np.int32), np.arange(len(symbols))
        rank = self.ranks(symbols[:, :-1], symbols[:, 1:])
        while len(row):
            at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(row), np.int64)
            best = rank[np.arange(len(row)), at] if rank.shape[1] else np.full(len(row), NO_RANK)
            go = best < NO_RANK
            out[row[~go], : symbols.shape[1]] = symbols[~go]
            row, at, best, symbols, rank = row[go], at[go], best[go], symbols[go], rank[go]
            if not len(row):
                break
            here, beyond = np.arange(len(row)), np.arange(symbols.shape[1] - 1) > at[:, None]
            symbols[here, at] = self.whole_of[best]
            symbols = np.where(beyond, symbols[:, 1:], symbols[:, :-1])  # each row is shorter by one
            rank = np.where(beyond[:, 1:], rank[:, 1:], rank[:, :-1])
            for place, mine in ((at - 1, at > 0), (at, at < rank.shape[1])):
                i, j = here[mine], place[mine]
                rank[i, j] = self.ranks(symbols[i, j], symbols[i, j + 1])
        return out


_WORKER: dict = {}


def worker_encoder(kind, path: str, cache_entries: int = CACHE_ENTRIES):
    """The encoder of this Python worker; its dictionary is kept over tasks."""
    if (key := (kind, path, cache_entries)) not in _WORKER:
        _WORKER[key] = kind(path, cache_entries)
    return _WORKER[key]


def encoded_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode it again.

    docs: any frame with an id and a text column; other columns are ignored. path: the vocabulary file, the same on all
    nodes. Returns doc_id, n_tokens, ids_sha256, decoded_sha256; a null text counts as empty, repeated rows stay.
    Map only: no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_encoder(ByteBpe, path)
        for batch in batches:
            sizes, coded, plain = [], [], []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py() or "")
                sizes.append(len(ids) // 4)
                coded.append(hashlib.sha256(ids).hexdigest())
                plain.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(coded, pa.string()), pa.array(plain, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.selectExpr(f"cast(`{id_col}` as long) AS doc_id", f"`{text_col}` AS text").mapInArrow(run, TOKENS_SCHEMA)
