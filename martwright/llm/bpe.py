"""BPE encoding and decoding with a minimal acyclic transducer of frequent words."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martwright.llm.common import arrow_map, as_bytes
from martwright.llm.pretokens import PackedIds, Vocabulary, blocks, packed_ids, vocabulary

# Words compiled at most, and how many of its most frequent ones a task reports at most. Both
# change only how many words are merged anew.
LEXICON_WORDS = 1 << 15
_TASK_WORDS = 1 << 12
_WORD_BYTES = 32
_SLICE = 2 << 20
_ARRAYS = ("keys", "target", "skip", "final", "offsets", "ids")


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """Minimal acyclic transducer from words to ids, as one block of arrays.

    Words come in sorted order, and states with the same future are shared as soon as they
    can no longer change. Each edge carries the number of words before it; their sum along a
    word is its rank, which finds its ids.
    """
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    path: list[tuple[list, list]] = [([False], [])]  # open states of the last word
    last = b""

    def close(depth: int) -> None:
        """Share or register the open states below a depth."""
        while len(path) - 1 > depth:
            final, edges = path.pop()
            form = (final[0], tuple(edges))
            if form not in register:
                register[form] = len(states)
                states.append(form)
            parent = path[-1][1]
            parent[-1] = (parent[-1][0], register[form])

    ordered = sorted(words)
    for word in ordered:
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        close(same)
        for byte in word[same:]:
            path[-1][1].append((byte, -1))
            path.append(([False], []))
        path[-1][0][0] = True
        last = word
    close(0)
    states.append((path[0][0][0], tuple(path[0][1])))
    below: list[int] = []
    keys, target, skip = [], [], []
    for state, (final, edges) in enumerate(states):
        passed = int(final)
        for byte, to in edges:
            keys.append(state * 256 + byte)
            target.append(to)
            skip.append(passed)
            passed += below[to]
        below.append(passed)
    ids = [words[w] for w in ordered]
    arrays = {
        "keys": np.array(keys, "<i8"),
        "target": np.array(target, "<i4"),
        "skip": np.array(skip, "<i4"),
        "final": np.array([s[0] for s in states], "u1"),
        "offsets": np.cumsum([0, *map(len, ids)]).astype("<i8"),
        "ids": np.fromiter(chain.from_iterable(ids), "<u4"),
    }
    parts, at, spec = [], 0, {}
    for name in _ARRAYS:
        data = arrays[name].tobytes()
        spec[name] = (arrays[name].dtype.str, at, len(arrays[name]))
        data += bytes(-len(data) % 8)
        parts.append(data)
        at += len(data)
    head = json.dumps({"root": len(states) - 1, "arrays": spec}).encode()
    head += b" " * (-(len(head) + 8) % 8)
    return len(head).to_bytes(8, "little") + head + b"".join(parts)


class Lexicon:
    """A compiled transducer, memory-mapped; words are looked up many at a time."""

    def __init__(self, path: str):
        block = np.memmap(path, np.uint8, "r")
        size = int.from_bytes(block[:8].tobytes(), "little")
        head = json.loads(block[8 : 8 + size].tobytes())
        self.root = head["root"]
        for name, (kind, at, count) in head["arrays"].items():
            start = 8 + size + at
            width = np.dtype(kind).itemsize
            setattr(self, name, block[start : start + width * count].view(kind))

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """Rank of each word, -1 for those not in the lexicon."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        out = np.full(len(words), -1, np.int64)
        at = np.flatnonzero((sizes > 0) & (sizes <= _WORD_BYTES))
        if not len(at) or not len(self.keys):
            return out
        letters = np.array([words[i] for i in at], f"S{_WORD_BYTES}").view(np.uint8).reshape(-1, _WORD_BYTES)
        size = sizes[at]
        state = np.full(len(at), self.root, np.int64)
        rank = np.zeros(len(at), np.int64)
        live = np.arange(len(at))
        for column in range(int(size.max())):
            live = live[size[live] > column]
            key = state[live] * 256 + letters[live, column]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[edge] == key
            state[live[~found]] = -1
            size[live[~found]] = 0
            live, edge = live[found], edge[found]
            state[live] = self.target[edge]
            rank[live] += self.skip[edge]
        ends = state >= 0
        ends[ends] = self.final[state[ends]] == 1
        out[at[ends]] = rank[ends]
        return out

    def packed(self, rank: int) -> bytes:
        return self.ids[self.offsets[rank] : self.offsets[rank + 1]].tobytes()


class TransducerEncoder:
    """Words from the transducer, others by exact merges; both remembered up to a limit."""

    def __init__(self, lexicon: Lexicon, merges: PackedIds, limit: int = 200_000):
        self.lexicon, self.merges, self.limit = lexicon, merges, limit
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed little-endian 32-bit ids of each text."""
        cut = [self.merges.words.pretokens(text) for text in texts]
        if len(self.known) >= self.limit:
            self.known.clear()
        new = [w for w in set(chain.from_iterable(cut)) if w not in self.known]
        for word, rank in zip(new, self.lexicon.ranks([w.encode() for w in new])):
            self.known[word] = self.lexicon.packed(rank) if rank >= 0 else self.merges[word]
        return [b"".join(map(self.known.__getitem__, words)) for words in cut]


def decode_ids(packed: bytes, tokens: list[str]) -> str:
    """The vocabulary file names no decoder: tokens, special ones too, are joined by spaces."""
    return " ".join(map(tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


@lru_cache(maxsize=2)
def _token_list(path: str) -> list[str]:
    words: Vocabulary = vocabulary(path)
    if words.tokenizer.decoder is not None:
        raise ValueError("only vocabularies without a decoder are supported")
    return [words.tokenizer.id_to_token(i) for i in range(words.tokenizer.get_vocab_size())]


def _frequent(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, counts = vocabulary(path), Counter()
    for rows in batches:
        for text in rows.column("text"):
            for part in blocks(text.as_py().decode()):
                counts.update(words.pretokens(part))
            if len(counts) > 60 * _TASK_WORDS:
                counts = Counter(dict(counts.most_common(30 * _TASK_WORDS)))
    top = [(w, n) for w, n in counts.most_common(_TASK_WORDS) if len(w.encode()) <= _WORD_BYTES]
    yield pa.RecordBatch.from_arrays(
        [pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())],
        names=["word", "n"],
    )


def build_lexicon(docs: DataFrame, tokenizer: str, size: int = LEXICON_WORDS) -> str:
    """Compile the most frequent words of all texts and hand the file to every worker.

    Each task reports its most frequent words; their sums choose the lexicon. At most ``size``
    words of at most 32 bytes reach the driver. Returns the file's name on the workers.
    """
    spark = docs.sparkSession
    top = (
        arrow_map(docs.select(as_bytes()), partial(_frequent, tokenizer), "word string, n long")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "word")
        .limit(size)
        .collect()
    )
    words = vocabulary(tokenizer)
    compiled = compile_lexicon({row["word"].encode(): words.ids(row["word"]) for row in top})
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = f"{tempfile.mkdtemp(prefix='martwright-')}/{name}"
    with open(path, "wb") as out:
        out.write(compiled)
    spark.sparkContext.addFile(path)
    return name


@lru_cache(maxsize=1)
def _encoder(name: str, tokenizer: str) -> TransducerEncoder:
    return TransducerEncoder(Lexicon(SparkFiles.get(name)), packed_ids(tokenizer))


def _round_trip(name: str, tokenizer: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder, tokens = _encoder(name, tokenizer), _token_list(tokenizer)

    def emit(doc_ids: list, texts: list[str]) -> pa.RecordBatch:
        if len(texts) == 1:
            packed = [b"".join(chain.from_iterable(map(encoder.encode, ([p] for p in blocks(texts[0])))))]
        else:
            packed = encoder.encode(texts)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(doc_ids, pa.int64()),
                pa.array(packed, pa.binary()),
                pa.array([decode_ids(p, tokens) for p in packed], pa.string()),
            ],
            names=["doc_id", "ids", "decoded"],
        )

    for rows in batches:
        doc_ids, texts, size = [], [], 0
        for doc_id, text in zip(rows.column("doc_id").to_pylist(), rows.column("text")):
            text = text.as_py()
            if texts and size + len(text) > _SLICE:
                yield emit(doc_ids, texts)
                doc_ids, texts, size = [], [], 0
            doc_ids.append(doc_id)
            texts.append(text)
            size += len(text)
        if texts:
            yield emit(doc_ids, texts)


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``(doc_id, ids, decoded)`` of every row; ``ids`` holds little-endian unsigned 32-bit integers.

    Whole texts are encoded as the vocabulary file's library does without added special
    tokens; special strings inside a text are their ids. ``decoded`` is the text made of the
    ids again, special tokens included. NULL and empty texts have no ids and decode to the empty
    text. Repeated rows and rows without doc_id are treated like others; an empty table gives
    no rows. Other columns are not read.
    """
    name = build_lexicon(docs, tokenizer)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return arrow_map(
        rows, partial(_round_trip, name, tokenizer), "doc_id long, ids binary, decoded string"
    )
