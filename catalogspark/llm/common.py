"""Helpers shared by the operators: words, distributed running totals, encoders that live as long as a Python worker."""

from __future__ import annotations

from collections.abc import Iterator
from unicodedata import normalize

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..session import written

# A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cores(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def running_total(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Adds `name`: the sum of the integer column `value` over all rows up to this one in the order of `order`.

    The rows are range-sorted once.  Each task adds up its own range in a stream; the sums of the ranges, one row per
    partition, are then added on.  No task sees more than its range, whatever the keys.  `order` should be unique;
    rows that tie get distinct totals in any order.
    """
    part, local = f"_{name}_part", f"_{name}_local"
    schema = T.StructType([*df.schema.fields, T.StructField(part, T.IntegerType()), T.StructField(local, T.LongType())])

    def add_up(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        number, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            sums = np.cumsum(batch.column(value).to_numpy(zero_copy_only=False).astype("int64")) + total
            total = int(sums[-1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(sums), number, "int32")), pa.array(sums)],
                names=[*batch.schema.names, part, local])

    ranged = written(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(add_up, schema), "ranged")
    # One row per partition of the range sort: as many as there are tasks, not rows.
    ends = ranged.groupBy(part).agg(F.max(local).alias("_end"))
    sums = ends.select(F.col(part).alias("_of"), F.expr(
        f"coalesce(sum(_end) OVER (ORDER BY {part} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)").alias("_before"))
    return (ranged.join(sums, F.col(part) == F.col("_of"))
            .withColumn(name, F.col(local) + F.col("_before")).drop(part, local, "_of", "_before"))


# Encoders of this Python worker, by file; a worker serves many tasks.
_ENCODERS: dict[tuple[str, str], object] = {}
CACHED_WORDS = 200_000   # entries of a word table before it makes way for a new one; workers keep several tables
CACHED_LENGTH = 48       # longer chunks are not kept
_BLANKS = bytes.maketrans(b"\n\t\r", b"   ")
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class Recent:
    """A table of bounded size: when full, it is kept as the older one, and what is asked for again moves over."""

    def __init__(self, limit: int = CACHED_WORDS):
        self.limit, self.new, self.old = limit, {}, {}

    def turn(self) -> dict:
        if len(self.new) > self.limit:
            self.old, self.new = self.new, {}
        return self.new

    def missing(self, keys: set) -> list:
        """Keys in neither table; those in the older one are moved."""
        old, lacking = self.old, []
        for key in keys:
            value = old.get(key)
            if value is None:
                lacking.append(key)
            else:
                self.new[key] = value
        return lacking


class IdEncoder:
    """Token ids of whole texts by a `tokenizers` file, as little-endian unsigned 32-bit bytes.

    The file's tokenizer must drop white space, put letters and marks into different words, ignore case and close each
    word with "</w>".  Then a text's ids are those of its chunks between spaces, a chunk of letters (normalised ones)
    with ASCII marks behind them has the ids of both parts, and many words of letters can be encoded as one text and told apart by their
    ends.  What is not of this form is encoded as it is.
    """

    def __init__(self, path: str):
        import numpy as np
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.chunks, self.words, self.marks = Recent(), Recent(), {"": b""}
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, number in self.tokenizer.get_vocab().items():
            self.ends[number] = token.endswith("</w>")

    def _alone(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        return [np.array(code.ids, "<u4").tobytes()
                for code in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        import numpy as np

        for at in range(0, len(words), 1000):
            some = words[at:at + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(some) and stops[-1] == len(ids):
                code, stops = ids.tobytes(), (4 * stops).tolist()
                self.words.new.update(zip(some, [code[a:b] for a, b in zip([0, *stops], stops)]))
            else:  # a letter that the tokenizer takes for something else
                self.words.new.update(zip(some, self._alone(some)))

    @staticmethod
    def _letters(core: str) -> bool:
        """Whether a chunk's start is of letters only, as the tokenizer sees them: some letters are normalised to one with
        a combining mark behind it, which belongs to the marks that follow."""
        return core.isalpha() and (core.isascii() or normalize("NFC", core).lower().isalpha()) or not core

    def _codes(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk, of which few are repeated."""
        known, words = self.chunks.turn(), self.words.turn()
        parts, whole, cores = [], [], set()
        for chunk in self.chunks.missing({c for c in chunks if c not in known}):
            core = chunk.rstrip(_MARKS)
            if len(chunk) <= CACHED_LENGTH and self._letters(core):
                word = core.lower() if core.isascii() else core
                parts.append((chunk, word, chunk[len(core):]))
                if word and word not in words:
                    cores.add(word)
            else:
                whole.append(chunk)
        self._learn(self.words.missing(cores))
        words[""] = b""
        for chunk, word, mark in parts:
            if mark not in self.marks:
                if len(self.marks) > CACHED_WORDS:
                    self.marks = {"": b""}
                self.marks[mark] = self._alone([mark])[0]
            known[chunk] = words[word] + self.marks[mark]
        long = {}
        for at in range(0, len(whole), 1000):
            some = whole[at:at + 1000]
            for chunk, code in zip(some, self._alone(some)):
                (known if len(chunk) <= CACHED_LENGTH else long)[chunk] = code
        if long:
            return [known[c] if c in known else long[c] for c in chunks]
        return [known[c] for c in chunks]

    def encode(self, texts) -> list[bytes]:
        """The ids of each text of a list or Arrow array without nulls.  Arrow numbers the chunks, so that Python sees
        each only once a call: a call with more texts costs less a text."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string())
        _, ends, data = texts.buffers()
        ends = np.frombuffer(ends, np.int32)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
        if ends[0] == ends[-1]:
            return [b""] * len(texts)
        raw = bytes(memoryview(data)[ends[0]:ends[-1]]).translate(_BLANKS)
        ends = ends - ends[0]
        # A chunk ends behind a space or with its text.
        stop = np.zeros(len(raw) + 1, bool)
        np.equal(np.frombuffer(raw, np.uint8), 32, out=stop[1:])
        stop[ends] = True
        stops = np.flatnonzero(stop).astype(np.int32)
        chunks = pa.StringArray.from_buffers(len(stops) - 1, pa.py_buffer(stops), pa.py_buffer(raw)).dictionary_encode()
        codes = pa.array(self._codes(pc.utf8_rtrim(chunks.dictionary, " ").to_pylist()), pa.large_binary())
        _, places, ids = codes.take(chunks.indices).buffers()
        places, ids = np.frombuffer(places, np.int64)[np.searchsorted(stops, ends)].tolist(), memoryview(ids or b"")
        return [bytes(ids[low:high]) for low, high in zip(places, places[1:])]


class PieceCounter:
    """Number of tokens of whole texts by a sentencepiece model.

    No piece of such a model has a space after another character, so no merge crosses the start of a run of spaces:
    the text is counted chunk by chunk, a chunk being a run of spaces with the characters after it.
    """

    def __init__(self, path: str):
        import re

        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        inner = any("\u2581" in p.lstrip("\u2581") for p in pieces)
        # A model that removes spaces, or adds none at the start, is asked for whole texts.
        self.by_chunk = not inner and self.model.encode("a  b ", out_type=str)[-1] == "\u2581" and \
            self.model.encode("a", out_type=str)[0].startswith("\u2581")
        self.chunks = re.compile("[ ▁]*[^ ▁]+|[ ▁]+").findall
        self.known: dict[str, int] = {}

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.by_chunk:
            return len(self.model.encode(text, num_threads=1))
        known = self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        chunks, total = self.chunks(text), 0
        for at, chunk in enumerate(chunks):
            n = known.get(chunk) if at else None
            if n is None:
                # Alone, a chunk gets a space before it: it stands for the first of its own, but at the text's start.
                bare = chunk[1:] if at else chunk
                n = len(self.model.encode(bare, num_threads=1)) if bare else 1
                if at and len(chunk) <= CACHED_LENGTH:
                    known[chunk] = n
            total += n
        return total


def encoder(kind: type, path: str):
    """This worker's encoder of a file."""
    key = (kind.__name__, path)
    if key not in _ENCODERS:
        _ENCODERS[key] = kind(path)
    return _ENCODERS[key]
