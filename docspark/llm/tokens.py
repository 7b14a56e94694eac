"""Token ids: encoding, files of range-coded ids, flat files, and counts.

``encode_texts`` gives what the tokenizers library gives for whole texts. For
tokenizers that lower case and drop white space, no piece reaches across a space;
so a text is its chunks between spaces, and chunks and their words are remembered.
Texts of a batch (``Encoder.many``) are cut together, and each distinct chunk is looked
up once; the library is asked for many new words in a call.

**Coded files** (``write_coded``, ``read_coded``) hold documents in ascending id
order. A file is a row of parts; a part has its documents' ids and lengths, then
their token ids as range-coded blocks (see rangecoder). Reading checks every block.

**Flat files** (``write_flat``, ``count_flat``) hold nothing but 16-bit ids, with an
end id after each document. ``count_flat`` cuts files into blocks, finds the end ids of
a block with one vectorised comparison, and sends on a block's lengths and its last
end. A prefix scan over the blocks of a file (a window over one row a block) then
gives each block its first document's number and where that one began.

Defined results: a null text is an empty one; an empty document has its end id only;
a null document id is kept and comes first; rows with the same id stay apart, in
the order of their texts; an empty table gives no files and an empty result; ids
behind the last end id of a flat file count as a document that isn't ended. Other
columns are not read. A document must fit into a task's memory.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspark.llm import rangecoder
from docspark.llm.common import pieces, qualified, settle, work_dir
from docspark.llm.files import create, new_name, open_file, open_stream

VOCABULARY = "word_bpe_49k.json"
END_ID, FLAT_END = 2, 49407
#: Chunks and words that a generation of a worker's memo holds; there are two generations.
CHUNKS, WORDS = 250_000, 300_000
#: Words that are held for looking up many together, or those of the last texts if they have more.
TABLE = 600_000
FLAT_BLOCK = 1 << 22

#: A word, and ASCII punctuation behind it, which is one piece whatever it consists of.
WORD, PUNCTUATION = r"[A-Za-zÀ-ÖØ-öø-ÿ]+", r"[!-/:-@\[-`{-~]*"
_SIMPLE = re.compile(f"({WORD})({PUNCTUATION})").fullmatch
_SIMPLE_RE2 = f"^(?P<word>{WORD})(?P<end>{PUNCTUATION})$"
#: Bytes of text that are encoded at once, and words in a call of the library.
TOGETHER, CALL = 1 << 22, 1000


def vocabulary_path(name: str) -> str:
    """``name`` itself if it is a path, else the place of that public vocabulary."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class _Young(dict):
    """A bounded memo of two generations: what is used again outlives the change of generation."""

    def __init__(self, most: int, make):
        super().__init__()
        self.most, self.make, self.old = most, make, {}

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if got.__class__ is bytes:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = got
            return got
        return got[0]


class _Memo:
    """Bytes of 16-bit ids by chunk, and by the words in chunks."""

    def __init__(self, tokenizer, vocabulary: dict[str, int], suffix: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = tokenizer
        #: The same model for words between spaces, and which ids end a word.
        self.spaced = Tokenizer(tokenizer.model)
        self.spaced.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.last = np.zeros(1 << rangecoder.ID_BITS, bool)
        self.last[[i for piece, i in vocabulary.items() if piece.endswith(suffix)]] = True
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = iter(range(256, 512))
        #: Byte-level tokenizers write byte 0 to 255 as these characters.
        self.letters = {b: chr(b if b in printable else next(other)) for b in range(256)}
        self.words = _Young(WORDS, self._word)
        self.chunks = _Young(CHUNKS, self._chunk)
        #: Words that are looked up many at once, their ids in a row, and how many each has.
        self.names, self.flat, self.sizes = pa.array([], pa.string()), np.zeros(0, "<u2"), np.zeros(0, np.int64)

    def _known(self, w: str) -> str:
        return w if w.isascii() else "".join(map(self.letters.__getitem__, w.encode()))

    def _word(self, w: str) -> bytes:
        """A piece in lower case for which the pre-tokenizer has no further cut."""
        return array("H", [t.id for t in self.tokenizer.model.tokenize(self._known(w))]).tobytes() if w else b""

    def _words(self, words: list[str]) -> tuple[list, list]:
        """What ``_word`` gives for words of letters, by a call of the library for many of them: arrays of ids and of sizes."""
        flat, sizes = [], []
        for first in range(0, len(words), CALL):
            some = words[first : first + CALL]
            ids = np.array(self.spaced.encode_batch_fast([" ".join(map(self._known, some))], add_special_tokens=False)[0].ids, "<u2")
            n = np.diff(np.flatnonzero(self.last[ids]), prepend=-1)
            # No piece but the last of a word has the suffix; if some vocabulary breaks this, words are asked for one by one.
            if len(n) != len(some):
                alone = [*map(self._word, some)]
                ids, n = np.frombuffer(b"".join(alone), "<u2"), np.array([len(x) // 2 for x in alone])
            flat.append(ids)
            sizes.append(n)
        return flat, sizes

    def _look_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of ids in a row, their sizes, and which of them are those of ``words``, which are distinct."""
        place = pc.index_in(words, value_set=self.names)
        new = words.filter(place.is_null())
        place = place.fill_null(-1).to_numpy().astype(np.int64)
        if len(new):
            place[place < 0] = np.arange(len(self.names), len(self.names) + len(new))
            flat, sizes = self._words(new.to_numpy(zero_copy_only=False).tolist())
            self.names = pa.concat_arrays([self.names, new])
            self.flat, self.sizes = np.concatenate([self.flat, *flat]), np.concatenate([self.sizes, *sizes])
        flat, sizes = self.flat, self.sizes
        if len(self.names) > TABLE:
            self.names, self.flat, self.sizes = words, _dealt(flat, sizes, place), sizes[place]
        return flat, sizes, place

    def _chunk(self, chunk: str):
        """A chunk whose word is new isn't kept: most are never seen again."""
        if simple := _SIMPLE(chunk):
            word, end = simple.groups()
            word = word.lower()
            got = self.words.get(word)
            if got is None:
                got = self.words[word]
                return (got + self.words[end] if end else got,)
            return got + self.words[end] if end else got
        return self._whole(chunk)

    def _whole(self, chunk: str) -> bytes:
        return array("H", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes() if chunk else b""

    def several(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks in a row, and how many each has. A word is looked up once, whatever is behind it."""
        cut = pc.extract_regex(chunks, _SIMPLE_RE2)
        simple = cut.is_valid().to_numpy(zero_copy_only=False)
        words = pc.utf8_lower(pc.struct_field(cut, "word")).dictionary_encode()
        ends = pc.struct_field(cut, "end").dictionary_encode()
        others = chunks.filter(cut.is_null()).to_pylist()
        flat, sizes, place = self._look_up(words.dictionary)
        more = [*map(self.words.__getitem__, ends.dictionary.to_pylist()), *map(self._whole, others), b""]
        # Two parts a chunk: its word and what is behind it, or all of it and nothing.
        parts = np.empty((len(chunks), 2), np.int64)
        parts[simple, 0] = place[words.indices.drop_null().to_numpy()]
        parts[simple, 1] = ends.indices.drop_null().to_numpy() + len(sizes)
        nothing = len(sizes) + len(more) - 1
        parts[~simple, 0] = np.arange(nothing - len(others), nothing)
        parts[~simple, 1] = nothing
        flat = np.concatenate([flat, np.frombuffer(b"".join(more), "<u2")])
        sizes = np.concatenate([sizes, np.fromiter(map(len, more), np.int64, len(more)) // 2])
        return _dealt(flat, sizes, parts.ravel()), sizes[parts].sum(axis=1)


def _dealt(flat: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs ``which`` of ``flat`` in a row, which itself is a row of runs of ``sizes``."""
    n = sizes[which]
    ends = np.cumsum(n)
    kind = np.int32 if max(len(flat), ends[-1] if len(ends) else 0) < 1 << 31 else np.int64
    at = np.repeat(((np.cumsum(sizes) - sizes)[which] - ends + n).astype(kind), n)
    at += np.arange(len(at), dtype=kind)
    return flat[at]


class Encoder:
    """Texts to 16-bit ids. special_as_text: special tokens written in a text are ordinary text."""

    _kept: dict = {}

    def __init__(self, vocabulary: str, special_as_text: bool):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        path = vocabulary_path(vocabulary)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        if self.tokenizer.get_vocab_size() > 1 << rangecoder.ID_BITS:
            raise ValueError("ids of more than 16 bits")
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        kinds = [n["type"] for n in (parts.get("normalizer") or {}).get("normalizers", [])]
        cuts = [n["type"] for n in (parts.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        spaced = kinds == ["NFC", "Replace", "Lowercase"] and cuts == ["Split", "ByteLevel"] and parts["model"].get("end_of_word_suffix")
        self.memo = _Memo(self.tokenizer, parts["model"]["vocab"], parts["model"]["end_of_word_suffix"]) if spaced else None

    @classmethod
    def of(cls, vocabulary: str, special_as_text: bool) -> Encoder:
        """One a worker process and vocabulary."""
        key = (vocabulary, special_as_text)
        if key not in cls._kept:
            cls._kept[key] = cls(*key)
        return cls._kept[key]

    def ids(self, text: str) -> bytes:
        if self.memo is None:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
        return b"".join(map(self.memo.chunks.__getitem__, text.replace("\n", " ").split(" ")))

    def many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts in a row, and how many each has: what ``ids`` gives, with each distinct chunk looked up once."""
        if self.memo is None:
            got = [self.ids(t) for t in texts.to_pylist()]
            return np.frombuffer(b"".join(got), "<u2"), np.array([len(x) // 2 for x in got], np.int64)
        cut = pc.split_pattern(pc.replace_substring(texts.cast(pa.string()), "\n", " "), " ")
        chunks = cut.flatten().dictionary_encode()
        which = chunks.indices.to_numpy()
        flat, sizes = self.memo.several(chunks.dictionary)
        before = np.concatenate([[0], np.cumsum(sizes[which])])
        behind = np.cumsum(pc.list_value_length(cut).to_numpy(), dtype=np.int64)
        return _dealt(flat, sizes, which), np.diff(before[behind], prepend=0)


def encode_texts(texts: list[str], vocabulary: str = VOCABULARY, special_as_text: bool = False) -> list[np.ndarray]:
    encoder = Encoder.of(vocabulary, special_as_text)
    return [np.frombuffer(encoder.ids(t), "<u2") for t in texts]


# ---- coded files

MAGIC = b"IDBLOCK1"
PART = struct.Struct("<IQ")
DOC = np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<u8")])
#: A part has so many ids at most, unless the texts of one call of ``Encoder.many`` have more.
PART_IDS = 2 * rangecoder.BLOCK * rangecoder.LANES


def _by_bytes(batches):
    """Arrow batches cut so that the second column of a piece has TOGETHER bytes at most, or one row."""
    for b in batches:
        size = np.cumsum(pc.binary_length(b.column(1)).to_numpy(), dtype=np.int64)
        first = 0
        while first < b.num_rows:
            behind = max(first + 1, int(np.searchsorted(size, TOGETHER + (size[first - 1] if first else 0), "right")))
            yield b.slice(first, behind - first)
            first = behind


def _part(docs: list, ids: bytearray) -> bytes:
    code = b"".join(rangecoder.encode(np.frombuffer(bytes(ids), "<u2")))
    table = np.array([(0 if d is None else d, d is None, n) for d, n in docs], DOC).tobytes()
    return PART.pack(len(docs), len(code)) + struct.pack("<I", zlib.crc32(table)) + table + code


def write_coded(docs: DataFrame, folder: str | None = None, vocabulary: str = VOCABULARY, end_id: int = END_ID,
                doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A settled table of (path, first, docs, ids), a row each file; files by ascending ``first`` are in id order."""
    folder = qualified(docs.sparkSession, folder) if folder else work_dir(docs.sparkSession, "coded-ids")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    schema = pa.schema([("path", pa.string()), ("first", pa.int64()), ("docs", pa.int64()), ("ids", pa.int64())])

    def write(batches):
        encoder = Encoder.of(vocabulary, False)
        path, out, first, n_docs, n_ids = new_name(folder, "ids"), None, None, 0, 0
        held: list = []
        ids = bytearray()
        for b in _by_bytes(batches):
            docs, (found, sizes) = b.column(0).to_pylist(), encoder.many(b.column(1))
            if out is None:
                out, first = create(path), docs[0]
                out.write(MAGIC)
            elif len(ids) + 2 * (len(found) + len(docs)) > 2 * PART_IDS:
                out.write(_part(held, ids))
                n_docs, n_ids = n_docs + len(held), n_ids + len(ids) // 2
                held, ids = [], bytearray()
            ids += np.insert(found, np.cumsum(sizes), end_id).tobytes()
            held += zip(docs, (sizes + 1).tolist())
        if out is not None:
            out.write(_part(held, ids))
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": path, "first": first, "docs": n_docs + len(held), "ids": n_ids + len(ids) // 2}], schema=schema)

    return settle(rows.mapInArrow(write, "path string, first long, docs long, ids long"), "coded-files")


def coded_parts(stream):
    """(document table, ids) of each part of a coded file."""

    def take(n: int) -> bytes:
        got = stream.read(n)
        if len(got) != n:
            raise rangecoder.Damaged("the file ends early")
        return got

    if take(len(MAGIC)) != MAGIC:
        raise rangecoder.Damaged("not a file of coded ids")
    while head := stream.read(PART.size):
        n, size = PART.unpack(head)
        (crc,) = struct.unpack("<I", take(4))
        raw = take(n * DOC.itemsize)
        if zlib.crc32(raw) != crc:
            raise rangecoder.Damaged("a document table has another checksum")
        yield np.frombuffer(raw, DOC), rangecoder.decode(take(size))


def read_coded(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone but for where each file starts."""
    order = Window.orderBy(F.col("first").asc_nulls_first(), "path")
    based = files.select("path", (F.sum("ids").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("ids")).alias("base"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches):
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with open_stream(path) as stream:
                    for table, ids in coded_parts(stream):
                        n = table["n"].astype(np.int64)
                        ends = np.cumsum(n)
                        wide = ids.astype("<u4").tobytes()
                        crc = [zlib.crc32(memoryview(wide)[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist())]
                        columns = [pa.array(table["id"], mask=table["null"].astype(bool)), pa.array(base + ends - n), pa.array(n), pa.array(crc, pa.int64())]
                        yield pa.RecordBatch.from_arrays(columns, schema=schema)
                        base += int(ends[-1])

    return based.repartition(max(1, files.count())).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_binary(spark, sf_dir: str) -> DataFrame:
    return read_coded(write_coded(spark.read.parquet(f"{sf_dir}/documents.parquet")))


# ---- flat files


def write_flat(docs: DataFrame, folder: str | None = None, vocabulary: str = VOCABULARY, end_id: int = FLAT_END,
               doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A settled table of (path, number, doc_id): the number-th document of a file. No order is kept but that within files."""
    folder = qualified(docs.sparkSession, folder) if folder else work_dir(docs.sparkSession, "flat-ids")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    end = struct.pack("<H", end_id)

    def write(batches):
        encoder = Encoder.of(vocabulary, True)
        path, out, n = new_name(folder, "bin"), None, 0
        for b in pieces(batches):
            out = out or create(path)
            for t in b.column(1).to_pylist():
                out.write(encoder.ids(t) + end)
            number = pa.array(np.arange(n, n + b.num_rows))
            n += b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([path] * b.num_rows, pa.string()), number, b.column(0)], ["path", "number", "doc_id"])
        if out is not None:
            out.close()

    return settle(rows.mapInArrow(write, "path string, number long, doc_id long"), "flat-files")


def count_flat(paths: DataFrame, end_id: int = FLAT_END, block: int = FLAT_BLOCK) -> DataFrame:
    """path, number, n_tokens (without the end id) and ended for each document in the flat files of the column ``path``."""

    def blocks(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                with open_file(path) as f:
                    n = f.size() // 2
                k = -(-n // block)
                yield pa.RecordBatch.from_arrays([pa.array([path] * k, pa.string()), pa.array(np.arange(k)), pa.array([n] * k, pa.int64())], ["path", "block", "ids"])

    spark = paths.sparkSession
    tasks = settle(paths.mapInArrow(blocks, "path string, block long, ids long"), "flat-blocks")

    def scan(batches):
        for b in batches:
            for path, k, n in zip(*(c.to_pylist() for c in b.columns)):
                with open_file(path) as f:
                    f.seek(2 * k * block)
                    ids = np.frombuffer(f.read(2 * min(block, n - k * block)), "<u2")
                ends = np.flatnonzero(ids == end_id) + k * block
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path], pa.string()), pa.array([k]), pa.array([n], pa.int64()), pa.array([ends.tolist()], pa.list_(pa.int64()))],
                    ["path", "block", "ids", "ends"],
                )

    parts = min(max(1, tasks.count()), 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    found = settle(tasks.repartition(parts).mapInArrow(scan, "path string, block long, ids long, ends array<long>"), "flat-ends")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scanned = found.select("path", "block", "ids", F.size("ends").alias("n"), F.try_element_at("ends", F.lit(-1)).alias("end")).select(
        "path", "block",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"),
        F.coalesce(F.last("end", ignorenulls=True).over(before), F.lit(-1)).alias("since"),
        F.when(F.row_number().over(Window.partitionBy("path").orderBy(F.desc("block"))) == 1, F.col("ids") - 1).alias("final"),
    )
    rows = found.select("path", "block", "ends").join(scanned, ["path", "block"])
    # Behind the last end of a file, what is left is one more document.
    open_end = F.when(F.col("final") > F.coalesce(F.try_element_at("ends", F.lit(-1)), F.col("since")), F.array(F.struct((F.col("final") + 1).alias("at"), F.lit(False).alias("ended"))))
    ends = F.concat(F.transform("ends", lambda e: F.struct(e.alias("at"), F.lit(True).alias("ended"))), F.coalesce(open_end, F.array().cast("array<struct<at:bigint,ended:boolean>>")))
    sized = F.transform(
        ends,
        lambda e, i: F.struct(
            (F.col("first") + i).alias("number"), (e["at"] - F.when(i == 0, F.col("since")).otherwise(F.get("ends", i - 1)) - 1).alias("n_tokens"), e["ended"].alias("ended")
        ),
    )
    return rows.select("path", F.inline(sized))


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    written = write_flat(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = count_flat(written.select("path").distinct())
    return written.join(counts, ["path", "number"]).select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"))
