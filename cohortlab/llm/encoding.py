"""Token ids of whole texts by a public byte-level BPE vocabulary.

``BatchEncoder`` cuts texts into space-separated chunks, hands the chunks it has
not met to the tokenizers library in one call, and puts the ids of a text together
from its chunks. This gives the ids of the whole text: the vocabulary's splitting
rule starts a new piece at a space, except where white space stands on both sides
of the cut; such texts are passed to the library whole, and so are texts with a
special token's string. The table of chunks is bounded in bytes.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator

import numpy as np

VOCABULARY = "byte_bpe_50k.json"
#: Bytes that a worker's table of chunks may take, both generations together.
TABLE_BYTES = 32 * 1024 * 1024
#: The same for a query that has its workers to itself; the workers of the pipeline hold other tables too.
ALONE_BYTES = 128 * 1024 * 1024
#: What an entry takes beside its characters and value (dict slot, str and bytes objects).
ENTRY_BYTES = 220
#: Longer texts are cut at spaces between other characters; texts are encoded in runs of this size.
PART_CHARS, RUN_CHARS = 200_000, 1_000_000
#: Characters of new chunks in one call of the library, whose result takes some hundred bytes a token.
LEARN_CHARS = 100_000


def byte_letters() -> list[str]:
    """The letter by which a byte-level vocabulary writes each byte: printable
    bytes stand for themselves, the others follow from code point 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def tokenizer_path(vocabulary: str) -> str:
    """A vocabulary file: a path, or the name of one of the public files."""
    if os.path.exists(vocabulary):
        return vocabulary
    import public_tokenizers
    return public_tokenizers.path(vocabulary)


def parts(text: str, chars: int = PART_CHARS) -> list[str]:
    """``text`` cut before single spaces that stand between other characters."""
    out, at = [], 0
    while len(text) - at > chars:
        cut = text.find(" ", at + chars)
        while cut >= 0 and (text[cut - 1].isspace() or not text[cut + 1:cut + 2].strip()):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def runs(texts: list[str], chars: int = RUN_CHARS) -> Iterator[list[int]]:
    """Positions of consecutive texts that hold about ``chars`` characters together."""
    here, held = [], 0
    for i, t in enumerate(texts):
        here.append(i)
        held += len(t)
        if held >= chars:
            yield here
            here, held = [], 0
    if here:
        yield here


def chunked(text: str) -> list[str] | None:
    """Chunks of a text, the first without its space; none where the rule does not hold."""
    return None if "  " in text or text[-1].isspace() else text.split(" ")


class ChunkTable(dict):
    """chunk -> value, bounded in bytes. Two generations: what is asked for again
    moves to the new one, the rest falls out. Unknown chunks are learnt together;
    those that end in white space have no value (False)."""

    def __init__(self, learn: Callable[[list[str]], Iterable[tuple[str, object, int]]], limit: int = TABLE_BYTES):
        super().__init__()
        self.learn, self.limit, self.held = learn, limit, 0
        self.old: dict[str, object] = {}
        self.unknown: set[str] = set()

    def __missing__(self, chunk: str):
        got = self.old.get(chunk)
        if got is None:
            self.unknown.add(chunk)
        else:
            self[chunk] = got
            self.held += ENTRY_BYTES + len(chunk)
        return got

    def values_of(self, lists: list[list[str] | None]) -> list[list | None]:
        """Values of the chunks of each list (one run of texts at a time)."""
        if 2 * self.held > self.limit:
            self.old, self.held = dict(self), 0
            self.clear()
        got = [None if w is None else list(map(self.__getitem__, w)) for w in lists]
        if self.unknown:
            self._learn()
            for w, g in zip(lists, got, strict=True):
                if g is not None and None in g:
                    for i, v in enumerate(g):
                        if v is None:
                            g[i] = self[w[i]]
        return got

    def _learn(self) -> None:
        new, self.unknown = list(self.unknown), set()
        self.update((c, False) for c in new if c[-1:].isspace())
        todo = [c for c in new if not c[-1:].isspace()]
        for run in runs(todo, LEARN_CHARS):
            for chunk, value, size in self.learn([todo[i] for i in run]):
                self[chunk] = value
                self.held += ENTRY_BYTES + len(chunk) + size


class BatchEncoder:
    """ids of many texts as little-endian bytes (2 a token, 4 for large vocabularies)."""

    def __init__(self, vocabulary: str = VOCABULARY, table_bytes: int = TABLE_BYTES, plain: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(tokenizer_path(vocabulary))
        self.tok.encode_special_tokens = plain       # their strings are then ordinary text
        vocab = self.tok.get_vocab(with_added_tokens=True)
        size = max(vocab.values()) + 1
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.special = [] if plain else [t.content for t in self.tok.get_added_tokens_decoder().values()]
        # a letter of a byte-level token is a byte
        self.width = np.zeros(size, dtype=np.int64)
        for token, i in vocab.items():
            self.width[i] = len(token)
        # the splitting rule that the chunks rest on; texts of other vocabularies go whole
        self.chunked = (type(self.tok.pre_tokenizer).__name__ == "ByteLevel" and self.tok.normalizer is None
                        and not self.tok.pre_tokenizer.add_prefix_space and not any(" " in s for s in self.special))
        self.table = ChunkTable(self.learn, table_bytes)

    def ids(self, text: str) -> np.ndarray:
        ids = self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return np.array(ids, dtype=self.dtype)

    def learn(self, chunks: list[str]) -> Iterator[tuple[str, bytes, int]]:
        """Ids of new chunks, each with a space before it, by one call for all."""
        ids = self.ids(" " + " ".join(chunks))
        ends = np.cumsum([len(c.encode()) + 1 for c in chunks])
        cuts = [0, *(np.searchsorted(np.cumsum(self.width[ids]), ends) + 1).tolist()]
        raw, w = ids.tobytes(), self.dtype.itemsize
        for c, a, z in zip(chunks, cuts, cuts[1:]):
            yield c, raw[a * w:z * w], (z - a) * w

    def _run(self, texts: list[str]) -> list[bytes]:
        words = [chunked(t) for t in texts]
        firsts = [w and w.pop(0) for w in words]
        out = []
        for t, first, got in zip(texts, firsts, self.table.values_of(words), strict=True):
            # a chunk that ends in white space has no value, the text goes whole
            if got is None or first[-1:].isspace() or False in got:
                out.append(self.ids(t).tobytes())
            else:
                rest = b"".join(got)
                out.append(self.ids(first).tobytes() + rest if first else rest)
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text (null: empty), equal to the library's on the whole text."""
        out: list[list[bytes]] = [[] for _ in texts]
        queue, owner = [], []
        for i, t in enumerate(texts):
            if t and (not self.chunked or any(s in t for s in self.special)):
                out[i].append(self.ids(t).tobytes())
            elif t:
                for p in parts(t):
                    queue.append(p)
                    owner.append(i)
        for run in runs(queue):
            for i, ids in zip(run, self._run([queue[i] for i in run]), strict=True):
                out[owner[i]].append(ids)
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]


_ENCODERS: dict[tuple[str, bool, int], BatchEncoder] = {}


def encoder(vocabulary: str = VOCABULARY, plain: bool = False, table_bytes: int = TABLE_BYTES) -> BatchEncoder:
    """The worker's encoder of a vocabulary; its cache serves the worker's later tasks."""
    key = vocabulary, plain, table_bytes
    if key not in _ENCODERS:
        _ENCODERS[key] = BatchEncoder(vocabulary, table_bytes, plain)
    return _ENCODERS[key]


def slices(pdf, rows: int = 2048, chars: int = 8_000_000):
    """Cut a pandas batch so that no part holds much more than ``chars`` of text."""
    size = pdf["text"].map(lambda t: len(t) if t else 0).to_numpy()
    at, held = 0, 0
    for i, n in enumerate(size):
        if i > at and (i - at >= rows or held + n > chars):
            yield pdf.iloc[at:i]
            at, held = i, 0
        held += n
    if at < len(pdf):
        yield pdf.iloc[at:]
