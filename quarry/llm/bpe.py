"""BPE encoding and decoding with a pair occurrence index.

Words (pre-tokens) are encoded apart from each other, so the words that a run of documents brings anew are laid out
one after another in one symbol sequence, and an index maps each mergeable pair to all its positions there. The ranks
of the pairs present wait in a heap; the lowest is taken, its merge applied at all its positions, from left to right,
and the lists of the pairs to the left and right of each position are updated. A pair that comes up through a merge
enters the index under its own rank. So a merge that no text needs costs nothing, and one that many words need is
looked up once.

Encoded words, with what clings to them, are kept in a bounded memory (``MEMORY`` entries; the later half goes when it is full), which lasts as long as the
Python worker. Texts are handled whole, one after another; nothing else grows with the input.

Defined results: null and empty texts have no tokens and decode to the empty text. Special tokens that stand in a text
are single ids, as the library reads them.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from quarry.llm.common import tidy

#: Words whose encoding a worker remembers, and the longest word that it remembers.
MEMORY, LONGEST = 400_000, 40

_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
#: What plain Latin letters, digits and punctuation don't reach.
_BEYOND = re.compile("[^\x00-\u024f]")
#: Marks that a word alone may have behind it.
_STOPS = frozenset(".,;:!?")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it is printable, else the next from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """What a tokenizer file holds."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        ids, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in told["added_tokens"]}
        self.size = max([*ids.values(), *self.special.values()]) + 1
        self.token = [""] * self.size
        for k, v in {**ids, **self.special}.items():
            self.token[v] = k
        letters = byte_letters()
        self.inner = [ids[c] for c in letters]
        self.last = [ids[c + self.suffix] for c in letters]
        self.left, self.right, self.made, self.rank = [], [], [], {}
        for k, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.left.append(ids[a])
            self.right.append(ids[b])
            self.made.append(ids[a + b])
            self.rank.setdefault(ids[a] << 20 | ids[b], k)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special))) + ")") if self.special else None


def encode_words(v: Vocabulary, words: list[str]) -> list[list[int]]:
    """The ids of each word, by the pair occurrence index over all of them."""
    symbols, starts = [-1], []
    inner, last = v.inner, v.last
    for w in words:
        raw = w.encode("utf-8", "surrogatepass")
        starts.append(len(symbols))
        symbols.extend([inner[b] for b in raw[:-1]])
        symbols.append(last[raw[-1]])
        symbols.append(-1)
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rank_of = v.rank.get
    index: dict[int, list[int]] = {}
    for i, (a, b) in enumerate(zip(symbols, symbols[1:])):
        if (r := rank_of(a << 20 | b)) is not None:
            if r in index:
                index[r].append(i)
            else:
                index[r] = [i]
    ranks = list(index)
    heapq.heapify(ranks)
    while ranks:
        r = heapq.heappop(ranks)
        places = index.pop(r, None)
        if places is None:
            continue
        places.sort()
        a, b, new = v.left[r], v.right[r], v.made[r]
        for i in places:
            j = after[i]
            if symbols[i] != a or symbols[j] != b:
                continue  # an earlier merge took one of the two
            k, h = after[j], before[i]
            symbols[i], symbols[j] = new, -2
            after[i], before[k] = k, i
            for left, at in ((symbols[h] << 20 | new, h), (new << 20 | symbols[k], i)):
                if (q := rank_of(left)) is not None:
                    if q in index:
                        index[q].append(at)
                    else:
                        index[q] = [at]
                        heapq.heappush(ranks, q)
    ends = [*(s - 1 for s in starts[1:]), n - 1]
    return [[x for x in symbols[s:e] if x >= 0] for s, e in zip(starts, ends, strict=True)]


def library_words(library):
    """The same by the tokenizers library's model, for operators whose ids are to come from it."""
    model = library.model
    letter = dict(enumerate(byte_letters()))

    def encode(v: Vocabulary, words: list[str]) -> list[list[int]]:
        return [[t.id for t in model.tokenize(w if w.isascii() and w.isprintable() else w.encode("utf-8", "surrogatepass").decode("latin-1").translate(letter))] for w in words]

    return encode


class Encoder:
    """Texts to ids and back. library: the words' ids come from the tokenizers library instead of the pair index.

    What is remembered are the ids of what stands between white space: words never reach across it.
    """

    def __init__(self, path: str, library: bool = False, memory: int = MEMORY):
        from tokenizers import Tokenizer

        self.v, self.memory = Vocabulary(path), memory
        self.library = Tokenizer.from_file(path)
        self.words = library_words(self.library) if library else encode_words
        self.known: dict[str, bytes] = {}
        self.numbers = [str(k) for k in range(self.v.size)]

    def normalise(self, text: str) -> str:
        """Composed, in lower case. (White space needs no change: it only parts words.) Beyond plain Latin letters the library
        does it, whose tables of characters may be of another age than Python's."""
        if text.isascii() or not _BEYOND.search(text):
            return text.lower()
        return self.library.normalizer.normalize_str(text)

    def split(self, chunk: str) -> list[str]:
        """The words of a chunk; beyond plain Latin letters as the library tells letters and numbers."""
        if chunk.isascii():
            if chunk.isalpha():
                return [chunk]
            if chunk[-1:] in _STOPS and chunk[:-1].isalpha():
                return [chunk[:-1], chunk[-1]]
            return _WORD.findall(chunk)
        if not _BEYOND.search(chunk):
            return _WORD.findall(chunk)
        return [chunk[s:e] for _, (s, e) in self.library.pre_tokenizer.pre_tokenize_str(chunk)]

    def _chunk_ids(self, distinct: list[str]) -> list[bytes]:
        known, split = self.known, self.split
        words = {c: split(c) for c in distinct if c not in known}
        fresh = list(set().union(*words.values()).difference(known))
        for w, ids in zip(fresh, self.words(self.v, fresh) if fresh else [], strict=True):
            known[w] = array("I", ids).tobytes()
        get = known.__getitem__
        for c, ws in words.items():
            if c not in known:
                known[c] = b"".join(map(get, ws))
        out = [get(c) for c in distinct]
        for c in [c for c in words if len(c) > LONGEST]:
            for w in (c, *words[c]):
                if len(w) > LONGEST:
                    known.pop(w, None)
        if len(known) > self.memory:  # what came first is what comes often
            self.known = dict(islice(known.items(), self.memory // 2))
        return out

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        """Texts without special tokens: split and told apart by Arrow, put together by index."""
        lists = pc.ascii_split_whitespace(pa.array(list(map(self.normalise, texts)), pa.large_string()))
        told = lists.values.dictionary_encode()
        found = self._chunk_ids(told.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        every = np.frombuffer(b"".join(found), "<u4")
        start = np.cumsum(size) - size
        index = told.indices.to_numpy(zero_copy_only=False)
        length = size[index]
        end = np.cumsum(length)
        flat = every[np.repeat(start[index] - (end - length), length) + np.arange(end[-1] if len(end) else 0)]
        bounds = np.concatenate([[0], end])[lists.offsets.to_numpy()]
        return [flat[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text as unsigned 32-bit numbers."""
        parts: list[str] = []
        place: list[list[int]] = []  # of each text: where its parts are, or minus one less the id of a special token
        for t in texts:
            own: list[int] = []
            for k, part in enumerate(self.v.split.split(t) if t and self.v.split and "<" in t else [t or ""]):
                if k % 2:
                    own.append(-1 - self.v.special[part])
                else:
                    own.append(len(parts))
                    parts.append(part)
            place.append(own)
        found = self._plain(parts)
        return [found[own[0]] if len(own) == 1 else np.concatenate([found[x] if x >= 0 else np.array([-1 - x], "<u4") for x in own]) for own in place]

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(map(self.v.token.__getitem__, ids))


_made: dict[tuple, Encoder] = {}


def encoder(path: str, library: bool = False) -> Encoder:
    """One for each Python worker."""
    key = (path, library)
    if key not in _made:
        _made[key] = Encoder(path, library)
    return _made[key]


#: Characters of text whose words are laid out in one symbol sequence, or a single text if it is longer.
RUN_CHARS = 1_000_000


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], list[str | None]]]:
    """Ids and texts (the first two columns) of so many rows."""
    keys: list[int | None] = []
    texts: list[str | None] = []
    held = 0
    for b in batches:
        for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            keys.append(k)
            texts.append(t)
            held += len(t or "")
            if held >= RUN_CHARS:
                yield keys, texts
                keys, texts, held = [], [], 0
    if keys:
        yield keys, texts


ROUND_TRIP = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode and decode each text (columns doc_id and text): number of ids, and digests of the ids and of the decoded text."""
    path = path or default_path()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for keys, texts in runs(batches):
            counts, ids_hash, text_hash = [], [], []
            for raw in e.encode(texts):
                ids = raw.tolist()
                counts.append(len(ids))
                ids_hash.append(hashlib.sha256(" ".join(map(e.numbers.__getitem__, ids)).encode()).hexdigest())
                text_hash.append(hashlib.sha256(e.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], schema=ROUND_TRIP)

    return docs.mapInArrow(tidy(work), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
