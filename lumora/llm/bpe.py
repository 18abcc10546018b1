"""BPE encoding and decoding with a lexicon automaton.

The tokenizer file (a ``tokenizers`` JSON of a word-end BPE: NFC, white space, lower case, a split into
words, bytes as printable characters, merges) is read, never trained. Words that are frequent in the
corpus are encoded once, on the driver, and compiled into a minimal acyclic transducer with their ids
as outputs. The file goes to the shared folder, Spark hands it to each executor, and workers map it
into memory. A word of the lexicon costs one walk over its bytes; any other word is merged exactly.
Counting the words takes one pass with a shuffle of words and counts; encoding is one pass without.

Nulls and odd rows: a null text is an empty one and has no ids; the strings of special tokens in a text
give their ids, as in the library. Decoding joins the tokens' strings by a space (the file has no decoder).
"""

from __future__ import annotations

import json
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.llm.automaton import Lexicon, compile_lexicon
from lumora.llm.common import give_back, long_batches, out_schema, release_after, shared_dir, small_batches

#: Chunks that a task remembers before it forgets all of them, some 250 bytes each, 400 with decoded texts; those it counts before it passes them on.
MEMO, COUNTED = 300_000, 200_000
#: Texts that are encoded together.
ENCODED_ROWS = 2048
_MARKS = ".,;:!?\"()[]{}|#$%&*+-/<=>@\\^_`~"
_SPLIT_ONLY_BY_STR = regex.compile("[\x1c-\x1f]")


@dataclass
class Tokenizer:
    """What encoding and decoding need of the file, in plain values that can be sent to workers."""

    vocab: dict[str, int]
    ranks: dict[tuple[str, str], int]
    special: dict[str, int]
    pattern: str
    end: str

    @classmethod
    def load(cls, path: str) -> Tokenizer:
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        model = j["model"]
        kinds = [x["type"] for x in j["normalizer"]["normalizers"]]
        splits = j["pre_tokenizer"]["pretokenizers"]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in splits] != ["Split", "ByteLevel"] or j["decoder"] or not model["end_of_word_suffix"]:
            raise ValueError("not a lower-case BPE with word ends")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        return cls(model["vocab"], {m: i for i, m in enumerate(merges)}, {x["content"]: x["id"] for x in j["added_tokens"]}, splits[0]["pattern"]["Regex"], model["end_of_word_suffix"])


def byte_characters() -> list[str]:
    """A printable character for each byte: printable Latin-1 stands for itself, the rest from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else extra))
        extra += b not in plain
    return out


class Codec:
    """Encode and decode single texts, with a lexicon or without."""

    def __init__(self, tok: Tokenizer, lexicon: Lexicon | None = None) -> None:
        self.tok, self.lexicon = tok, lexicon
        self.word = regex.compile(tok.pattern)
        self.special = regex.compile("(" + "|".join(map(regex.escape, tok.special)) + ")") if tok.special else None
        self.chars = byte_characters()
        self.strings = {i: t for t, i in tok.vocab.items()} | {i: t for t, i in tok.special.items()}
        self.decimals = {i: str(i) for i in self.strings}

    def merge(self, word: bytes) -> list[int]:
        """Apply the merges to one word, the lowest rank first, the leftmost of equals."""
        parts = [self.chars[b] for b in word]
        parts[-1] += self.tok.end
        rank, none = self.tok.ranks.get, len(self.tok.ranks)
        pairs = [rank(p, none) for p in zip(parts, parts[1:], strict=False)]
        while pairs:
            best = min(pairs)
            if best == none:
                break
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = rank((parts[at - 1], parts[at]), none)
            if at < len(pairs):
                pairs[at] = rank((parts[at], parts[at + 1]), none)
        vocab = self.tok.vocab
        return [vocab[p] for p in parts if p in vocab]

    def words(self, chunk: str) -> list[bytes]:
        """The words of a text without special tokens."""
        text = chunk.lower() if chunk.isascii() else normalize("NFC", chunk).replace("Σ", "σ").lower()
        if text.isalpha():
            return [text.encode("utf-8", "replace")]
        core = text.rstrip(_MARKS)
        if core.isalpha():  # a word and marks after it, the commonest case by far
            return [core.encode("utf-8", "replace"), text[len(core) :].encode()]
        return [w.encode("utf-8", "replace") for w in self.word.findall(text)]

    def chunk(self, chunk: str) -> list[int]:
        out: list[int] = []
        for w in self.words(chunk):
            ids = self.lexicon.get(w) if self.lexicon else None
            out += self.merge(w) if ids is None else ids
        return out

    def pieces(self, text: str) -> Iterator[tuple[bool, str]]:
        """Special tokens (True) and chunks between white space (False), in order. No word crosses white space."""
        for k, part in enumerate(self.special.split(text) if self.special and "<" in text else [text]):
            if k % 2:
                yield True, part
            elif _SPLIT_ONLY_BY_STR.search(part):  # str.split() takes them for white space, the pattern doesn't
                yield False, part
            else:
                for c in part.split():
                    yield False, c

    def encode(self, text: str | None) -> list[int]:
        return [i for special, p in self.pieces(text or "") for i in ([self.tok.special[p]] if special else self.chunk(p))]

    def decode(self, ids: list[int]) -> str:
        try:
            return " ".join([self.strings[i] for i in ids])
        except KeyError:
            return " ".join([self.strings[i] for i in ids if i in self.strings])


class _Memo(dict):
    """For each chunk how many ids it has, their decimals joined by a space and, if wanted, the text decoded from them."""

    def __init__(self, codec: Codec, decoded: bool, size: int) -> None:
        super().__init__()
        self.codec, self.decoded, self.size = codec, decoded, size

    def __missing__(self, chunk: str) -> tuple:
        if len(self) >= self.size:
            self.clear()
        ids = self.codec.chunk(chunk)
        texts = self.codec.decimals
        ids_text = " ".join([texts[i] for i in ids])
        got = self[chunk] = (len(ids), ids_text, self.codec.decode(ids)) if self.decoded else (len(ids), ids_text)
        return got


def _plain(col: pa.Array, codec: Codec) -> tuple[pa.Array, dict[int, str]]:
    """Texts with null and those with special tokens as empty ones, and the latter by row."""
    col = (col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col).cast(pa.large_string()).fill_null("")
    odd: dict[int, str] = {}
    if codec.special is not None:
        on = pc.match_substring_regex(col, "|".join(re.escape(t) for t in codec.tok.special))
        if pc.any(on).as_py():
            odd = {i: col[i].as_py() for i in pc.indices_nonzero(on).to_pylist()}
            col = pc.if_else(on, pa.scalar("", pa.large_string()), col)
    return col, odd


def count_words(docs: DataFrame, tok: Tokenizer, text_col: str = "text") -> DataFrame:
    """Words of all texts and how often they occur: word binary, n long."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(tok)

    def flush(chunks: Counter, codec: Codec) -> pa.RecordBatch:
        words: Counter = Counter()
        for c, n in chunks.items():
            for w in codec.words(c):
                words[w] += n
        return pa.record_batch([pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, chunks = Codec(held.value), Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                if t and ("<|" in t or _SPLIT_ONLY_BY_STR.search(t)):
                    chunks.update(p for special, p in codec.pieces(t) if not special)
                elif t:
                    chunks.update(t.split())
            if len(chunks) > COUNTED:
                yield flush(chunks, codec)
                chunks.clear()
        yield flush(chunks, codec)

    return docs.select(text_col).mapInArrow(release_after(run), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, tok: Tokenizer, *, text_col: str = "text", most: int = 1 << 16, least_count: int = 8) -> bytes:
    """Compile the ``most`` most frequent words that occur at least ``least_count`` times, of equally frequent ones the first by their
    bytes. A bound on the file, not on what is encoded; without texts it is empty."""
    top = count_words(docs, tok, text_col).where(F.col("n") >= least_count).orderBy(F.desc("n"), "word").limit(most).select("word").toArrow()
    codec = Codec(tok)
    out = compile_lexicon({w: codec.merge(w) for w in map(bytes, top["word"].to_pylist())})
    del top, codec
    give_back()
    return out


def share_file(spark: SparkSession, data: bytes, name: str) -> str:
    """Put bytes in the shared folder and have Spark hand the file to every executor; returns its name there."""
    name = f"{name}-{uuid.uuid4().hex}.bin"
    path = f"{shared_dir(spark)}/{name}"
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
    out = fs.create(p)
    for k in range(0, len(data), 1 << 20):
        out.write(bytearray(data[k : k + (1 << 20)]))
    out.close()
    fs.deleteOnExit(p)
    sc.addFile(path)
    return name


def encode(docs: DataFrame, tok: Tokenizer, lexicon: bytes | None, *, text_col: str = "text", outputs: tuple[str, ...] = ("ids",), keep: tuple[str, ...] = ("doc_id",), memo_size: int = MEMO, batch_bytes: int = 1 << 23) -> DataFrame:
    """The columns of ``keep`` and, as asked for, of each whole text: ``ids`` array<int>, ``n_tokens`` long,
    ``ids_text`` (decimal ids joined by a space) and ``decoded`` (the text decoded from the ids).

    A task takes texts of some ``batch_bytes`` at a time and remembers ``memo_size`` chunks.

    A null text is an empty one; rows that repeat are encoded each; very long texts are encoded whole; an empty table gives an empty
    result. A kept column with the name of an output is an error (ValueError); other columns may have any name.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kinds = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64(), "ids_text": pa.string(), "decoded": pa.string()}
    sql = {"ids": "array<int>", "n_tokens": "bigint", "ids_text": "string", "decoded": "string"}
    held = spark.sparkContext.broadcast(tok)
    name = share_file(spark, lexicon, "lexicon") if lexicon else None
    rows = docs.select(*keep, F.col(text_col).alias("_bpe_text"))
    schema = out_schema(docs, keep, {x: F.lit(None).cast(sql[x]) for x in outputs})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(held.value, Lexicon.map(SparkFiles.get(name)) if name else None)
        memo = _Memo(codec, "decoded" in outputs, memo_size)  # of this task: a worker that lives on keeps nothing

        def special_row(text: str, x: str) -> object:
            ids = codec.encode(text)
            return ids if x == "ids" else len(ids) if x == "n_tokens" else codec.decode(ids) if x == "decoded" else " ".join(map(str, ids))

        for b in long_batches(batches, ENCODED_ROWS, batch_bytes):
            # split, tell chunks apart, put the chunks' results in their places and join them: all by Arrow
            text, odd = _plain(b.column(b.num_columns - 1), codec)
            chunks = pc.ascii_split_whitespace(text)
            ends = np.asarray(chunks.offsets) - chunks.offsets[0].as_py()
            flat = chunks.flatten().dictionary_encode()
            known = [memo[c] for c in flat.dictionary.to_pylist()]
            n_of = np.array([k[0] for k in known], np.int64)
            at = flat.indices.to_numpy()
            if not n_of.all():  # chunks without ids leave no gap
                keep_token = n_of[at] > 0
                ends = np.concatenate([[0], np.cumsum(keep_token)])[ends]
                at = at[keep_token]
            take = pa.array(at)
            id_ends = np.concatenate([[0], np.cumsum(n_of[at])])[ends]
            out: dict[str, pa.Array] = {}
            for x in outputs:
                if x == "n_tokens":
                    out[x] = pa.array(np.diff(id_ends), pa.int64())
                elif x == "ids":
                    ids_of = pa.array([[int(i) for i in k[1].split()] for k in known], pa.list_(pa.int32()))
                    out[x] = pa.ListArray.from_arrays(pa.array(id_ends, pa.int32()), ids_of.take(take).flatten())
                else:
                    texts = pa.array([k[1 + (x == "decoded")] for k in known], pa.large_string())
                    out[x] = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), texts.take(take)), pa.scalar(" ", pa.large_string())).cast(pa.string())
                if odd:
                    rows_of = out[x].to_pylist()
                    for i, t in odd.items():
                        rows_of[i] = special_row(t, x)
                    out[x] = pa.array(rows_of, kinds[x])
            yield pa.record_batch([*b.columns[:-1], *[out[x].cast(kinds[x]) for x in outputs]], names=[*b.schema.names[:-1], *outputs])

    return rows.mapInArrow(release_after(run), schema)


def decode(rows: DataFrame, tok: Tokenizer, *, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add the text decoded from an array of ids; unknown ids are left out, a null array is an empty text."""
    held = rows.sparkSession.sparkContext.broadcast(tok)

    @F.pandas_udf("string")
    def run(ids):  # noqa: ANN001, ANN202
        codec = Codec(held.value)
        return ids.map(lambda x: codec.decode([] if x is None else x.tolist()))

    return rows.withColumn(out_col, run(F.col(ids_col)))
