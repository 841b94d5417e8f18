"""Exact SentencePiece BPE encoding by backtracking, and decoding.

A text is BPE-encoded piece by piece: at each position the longest vocabulary match (found by an Aho-Corasick
automaton) is tried first; it may follow its left neighbour only if re-merging the two pieces' characters gives back
exactly these two pieces. A bitfield keeps positions from which no tiling was found, so none is tried twice. Merge
order (score, then leftmost) makes this tiling unique and equal to the library's.

Merges never cross a boundary over which no vocabulary piece reaches, so texts are cut there first and the chunks are
cached in each worker process, for all its tasks of a query; an idle one soon drops them.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.llm._common import prepare

SPACE = "▁"
#: Entries of a worker's chunk cache and of its pair cache; chunks longer than this aren't kept.
CACHE_SIZE, PAIRS, LONGEST = 300_000, 1_000_000, 64
#: Seconds without a task after which a process lets its caches go.
IDLE = 2.0


class Pieces:
    """Encoder and decoder of one BPE model file with byte fallback and an identity normaliser."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        if train.model_type != 2 or not train.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or train.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with byte fallback and an identity normaliser are supported")
        if any(p.type not in (1, 2, 3, 6) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.prefix = norm.add_dummy_prefix
        self.pieces = [p.piece for p in model.pieces]
        self.kind = [p.type for p in model.pieces]
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        self.score = {p.piece: p.score for p in model.pieces if p.type == 1}
        self.bytes = [0] * 256
        for i, p in enumerate(model.pieces):
            if p.type == 6:
                self.bytes[int(p.piece[3:5], 16)] = i
        self.byte_of = {i: b for b, i in enumerate(self.bytes)}
        self.end = next(i for i, p in enumerate(model.pieces) if p.type == 3 and p.piece == "</s>")
        self.trie = ahocorasick.Automaton()
        for piece, i in self.id.items():
            self.trie.add_word(piece, i)
        self.trie.make_automaton()
        self.length = [len(p) for p in self.pieces]
        #: of each piece, the longest shorter one that it begins with (-1: none)
        self.shorter = [-1] * len(self.pieces)
        for piece, i in self.id.items():
            self.shorter[i] = next((self.id[b] for n in range(len(piece) - 1, 0, -1) if (b := piece[:n]) in self.id), -1)
        inner = [p for p in self.id if SPACE in p.lstrip(SPACE)]
        if inner:
            raise ValueError("pieces with an inner space mark are not supported")
        chars = {c for p in self.id for c in p}
        self.cut = self.cutter(chars)
        self.unknown = re.compile(f"[^{re.escape(''.join(sorted(chars)))}]")
        #: left * number of pieces + right -> fit(left, right); left -1: none
        self.pairs: dict[int, bool] = {}

    def cutter(self, chars: set[str]) -> re.Pattern[str]:
        """Chunks: runs of word characters or of others, with the spaces before them."""
        # word characters are the letters and digits that meet no other character within a piece
        words = {c for c in chars if c.isalnum()}
        beside = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}
        while mixed := {c for x in beside if SPACE not in x and (x[0] in words) != (x[1] in words) for c in x} & words:
            words -= mixed
        # characters of no piece never merge; the usual one is the line end
        line, word = "" if "\n" in chars else "\n", "".join(sorted(words))
        kinds = ["\n"] * bool(line) + [rf"[ {SPACE}]*[{word}]+"] * bool(word) + [rf"[ {SPACE}]*[^ {SPACE}{word}{line}]+", rf"[ {SPACE}]+"]
        return re.compile("|".join(kinds))

    def merge(self, chars: str) -> list[str]:
        """BPE by its definition: merge the adjacent pair whose union scores best, the leftmost of equals, while any can be."""
        part: list[str | None] = list(chars)
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(part) and (joint := part[i] + part[after[i]]) in self.score:
                heapq.heappush(heap, (-self.score[joint], i, joint))

        for i in range(len(part) - 1):
            offer(i)
        while heap:
            _, i, joint = heapq.heappop(heap)
            if part[i] is None or (j := after[i]) >= len(part) or part[i] + part[j] != joint:
                continue
            part[i], part[j] = joint, None
            after[i] = after[j]
            if after[j] < len(part):
                before[after[j]] = i
            offer(i)
            offer(before[i])
        return [p for p in part if p is not None]

    def fit(self, left: int, right: int) -> bool:
        """Whether merging the two pieces' characters gives these two pieces again; with no left one (-1), the right alone."""
        key = left * len(self.pieces) + right
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            want = [self.pieces[i] for i in (left, right) if i >= 0]
            known = self.pairs[key] = self.merge("".join(want)) == want
        return known

    def tile(self, chars: str) -> list[int]:
        """The pieces of characters that the vocabulary holds, by backtracking over longest matches."""
        size, total, length, shorter, pairs = len(chars), len(self.pieces), self.length, self.shorter, self.pairs
        longest = [-1] * size
        for last, piece in self.trie.iter(chars):
            longest[last - length[piece] + 1] = piece  # matches come by their ends: the last one at a start is the longest
        failed: bytearray | None = None
        out: list[int] = []
        at, left = 0, -1
        piece = longest[0] if size else -1
        while at < size:
            while piece >= 0:
                if failed is None or not failed[at + length[piece] >> 3] >> (at + length[piece] & 7) & 1:
                    fits = pairs.get(left * total + piece)
                    if fits if fits is not None else self.fit(left, piece):
                        break
                piece = shorter[piece]
            if piece >= 0:
                out.append(piece)
                at, left = at + length[piece], piece
                piece = longest[at] if at < size else -1
                continue
            if not out:
                return [self.id[p] for p in self.merge(chars)]
            # a tiling of the characters before a position is unique, so what fails here fails after any neighbour
            if failed is None:
                failed = bytearray(size // 8 + 1)
            failed[at >> 3] |= 1 << (at & 7)
            piece = out.pop()
            at, left = at - length[piece], out[-1] if out else -1
            piece = shorter[piece]
        return out

    def ids_of(self, chunk: str) -> list[int]:
        """Ids of one chunk, spaces already marked."""
        if not self.unknown.search(chunk):
            return self.tile(chunk)
        out: list[int] = []
        at = 0
        for m in self.unknown.finditer(chunk):  # characters of no piece are their bytes, and no merge reaches over them
            out.extend(self.tile(chunk[at : m.start()]))
            out.extend(self.bytes[b] for b in m[0].encode())
            at = m.end()
        return out + self.tile(chunk[at:])

    def chunks(self, text: str) -> list[str]:
        if self.prefix and text:
            text = " " + text
        return self.cut.findall(text)

    def encode(self, text: str) -> list[int]:
        """Ids without begin or end."""
        return [i for c in self.chunks(text) for i in self.ids_of(c.replace(" ", SPACE))]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: control pieces vanish, runs of byte pieces are UTF-8 (bad bytes become U+FFFD)."""
        out: list[str] = []
        run = bytearray()
        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                run.append(b)
                continue
            if run:
                out.append(bad_bytes(bytes(run)))
                run.clear()
            if self.kind[i] == 1:
                out.append(self.pieces[i])
            elif self.kind[i] == 2:
                out.append(" ⁇ ")
        if run:
            out.append(bad_bytes(bytes(run)))
        text = "".join(out)
        if self.prefix and text.startswith(SPACE):
            text = text[1:]
        return text.replace(SPACE, " ")


def bad_bytes(raw: bytes) -> str:
    """UTF-8, each byte that is part of no character becoming one U+FFFD."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        pass
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + n].decode())
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


class Worker:
    """Chunk caches of one Python worker: chunk -> its ids as text. Two generations bound them.

    The ids of each chunk are decoded when they are made; a line end before them says that they don't give the chunk again.
    """

    def __init__(self, path: str):
        self.model = Pieces(path)
        self.plain = [p.replace(SPACE, " ") if k == 1 else None for p, k in zip(self.model.pieces, self.model.kind, strict=True)]
        self.text = [str(i) for i in range(len(self.plain))]
        self.cache: dict[str, str] = {}
        self.older: dict[str, str] = {}

    def look(self, chunk: str) -> str:
        if (known := self.cache.get(chunk)) is None:
            if (known := self.older.get(chunk)) is None:
                ids = self.model.ids_of(chunk.replace(" ", SPACE))
                try:
                    back = "".join([self.plain[i] for i in ids])
                except TypeError:  # byte pieces; the first one keeps decode() from taking a leading space
                    back = self.model.decode([self.model.id["a"], *ids])[1:]
                known = "\n" * (back != chunk) + " ".join([self.text[i] for i in ids])
            if len(chunk) <= LONGEST:
                if len(self.cache) >= CACHE_SIZE:
                    self.older, self.cache = self.cache, {}
                self.cache[chunk] = known
        return known

    def ids(self, text: str) -> str:
        get, look = self.cache.get, self.look
        return " ".join([get(c) or look(c) for c in self.model.chunks(text)])

    def digest(self, text: str) -> tuple[int, str, str]:
        ids = self.ids(text)
        # a text whose chunks all come back as they were comes back as it was; the space that the encoder put before it goes again
        back = self.model.decode([int(i) for i in ids.split()]) if "\n" in ids else text
        ids = f"{ids} {self.model.end}".lstrip(" ").replace("\n", "")
        return ids.count(" ") + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.ids(text).split()]


@lru_cache(maxsize=1)
def _worker(path: str, query: str) -> Worker:
    return Worker(path)


_idle: threading.Timer | None = None


@contextmanager
def worker(path: str, query: str) -> Iterator[Worker]:
    """The worker of this process for one query: kept from task to task, and gone with another query or when no task follows.

    Spark keeps its Python processes; what they hold would be missing in other stages' memory.
    """
    global _idle
    if _idle:
        _idle.cancel()
    try:
        yield _worker(path, query)
    finally:
        _idle = threading.Timer(IDLE, _worker.cache_clear)
        _idle.daemon = True
        _idle.start()


def encode(spark: SparkSession, documents: DataFrame, path: str, text: str = "text", end: bool = True) -> DataFrame:
    """All columns of documents and piece_ids array<int>: the ids of the whole text, with the end id last if asked for.

    A null text counts as empty. A column piece_ids of the input is replaced. One map-side pass; rows keep their order.
    """
    return _mapped(spark, documents, path, text, lambda w: lambda t: w.encode(t) + ([w.model.end] if end else []), "array<int>", "piece_ids", pa.list_(pa.int32()))


def decode(spark: SparkSession, encoded: DataFrame, path: str, ids: str = "piece_ids") -> DataFrame:
    """All columns of encoded and decoded_text: the text of the ids (null ids: null)."""
    return _mapped(spark, encoded, path, ids, lambda w: lambda x: None if x is None else w.model.decode(x), "string", "decoded_text", pa.string(), keep_null=True)


def _mapped(spark: SparkSession, df: DataFrame, path: str, column: str, make, kind: str, name: str, arrow: pa.DataType, keep_null: bool = False) -> DataFrame:
    prepare(spark)
    source = df.withColumn("__in", F.col(column) if keep_null else F.coalesce(F.col(column), F.lit(""))).drop(name)
    names, query = [c for c in source.columns if c != "__in"], uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with worker(path, query) as w:
            work = make(w)
            for b in batches:
                out = pa.array([work(x) for x in b.column(len(names)).to_pylist()], arrow)
                yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], out], names=[*names, name])

    schema = source.select(names).schema
    return source.select(*names, "__in").mapInArrow(run, schema.add(name, _spark_type(kind), True))


def _spark_type(kind: str):
    from pyspark.sql import types as T

    return {"array<int>": T.ArrayType(T.IntegerType()), "string": T.StringType()}[kind]


def digests(spark: SparkSession, documents: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_tokens, ids_sha256, decoded_sha256): encoding with an end id, and its decoding, as digests.

    A null text counts as empty: only the end id, and the digest of nothing. Repeated keys give one row each.
    """
    prepare(spark)
    docs = documents.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    query = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with worker(path, query) as w:
            for b in batches:
                got = [w.digest(t) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.string()), pa.array([x[2] for x in got], pa.string())], names=["k", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["k"].dataType.simpleString()
    return docs.mapInArrow(run, f"k {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("k", key)
