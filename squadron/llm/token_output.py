"""Token-id output: Parquet lists of ids, dictionary-encoded, in bounded row groups with page indexes."""

from __future__ import annotations

import zlib
from itertools import repeat
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from squadron.llm.common import Scratch, documents, shuffle_partitions
from squadron.llm.textkit import KEPT, column, give_back, pieces

END = 0
#: Writer settings: small row groups and pages, so that a reader of few documents skips the rest by the page index.
LAYOUT = {
    "parquet.block.size": str(32 << 20), "parquet.page.size": str(256 << 10), "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "true", "parquet.dictionary.page.size": str(2 << 20), "compression": "snappy",
}
#: A worker keeps the ids of so many units of text that it sees; those of others serve one run of texts.
STORE = 200_000
#: Bytes of text encoded together.
RUN = 4 << 20
#: New units encoded in one call.
TOGETHER = 4000
#: Kinds of bytes: other, letter, digit, mark, blank, other white space, newline, apostrophe.
OTHER, LETTER, DIGIT, MARK, BLANK, WHITE, LINE, QUOTE = range(8)


def _kinds() -> np.ndarray:
    kind = np.full(256, OTHER, np.uint8)
    kind[:128] = MARK
    kind[48:58] = DIGIT
    kind[65:91] = kind[97:123] = LETTER
    kind[9:14], kind[10], kind[32], kind[39] = WHITE, LINE, BLANK, QUOTE
    kind[28:32] = OTHER  # white space to some
    return kind


def _cuts() -> np.ndarray:
    """For two neighbouring bytes' kinds (8 times the first and the second): a pattern's piece ends between them, whatever stands around."""
    cut = np.zeros((8, 8), bool)
    shown, blanks = [LETTER, DIGIT, MARK, QUOTE], [BLANK, WHITE, LINE]
    cut[np.ix_(shown, [*shown, *blanks])] = True
    for a, b in ((LETTER, LETTER), (DIGIT, DIGIT), (MARK, MARK), (MARK, QUOTE), (QUOTE, MARK), (QUOTE, QUOTE), (QUOTE, LETTER)):
        cut[a, b] = False
    return cut.reshape(-1)


KINDS, CUTS, SHOWN = _kinds(), _cuts(), np.isin(np.arange(8), [LETTER, DIGIT, MARK, QUOTE])
#: Bytes of text that go into a file, about.
FILE_BYTES = 256 << 20
_encoders: dict[tuple[str, bool], "Encoder"] = {}
KEPT.append(_encoders)


def unit_starts(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Bytes at which units begin: runs of letters, digits or marks with the blank before them, and white space.

    A byte-level BPE's pattern takes no more than one blank before letters, digits or marks, and looks at nothing before its
    place, so a text cut at these places has the ids of its units, one after the other. Beside characters outside ASCII it
    is cut only where they are Latin letters of two bytes or, before white space, where they are no white space.
    """
    kind = KINDS[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    lead = lead[(raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = LETTER
    cut = np.zeros(len(raw) + 1, bool)
    cut[1:-1] = CUTS[(kind[:-1] << 3) | kind[1:]]
    at = np.flatnonzero((kind[:-1] == OTHER) & (kind[1:] >= BLANK) & (kind[1:] <= LINE)) + 1
    if len(at):
        x, y, z = raw[at - 1], raw[np.maximum(at - 2, 0)], raw[np.maximum(at - 3, 0)]
        blank = (x < 128) | (y == 0xC2) & ((x == 0x85) | (x == 0xA0)) | (z == 0xE1) & ((y == 0x9A) & (x == 0x80) | (y == 0xA0) & (x == 0x8E))
        blank |= (z == 0xE2) & ((y == 0x80) & ((x <= 0x8A) | (x == 0xA8) | (x == 0xA9) | (x == 0xAF)) | (y == 0x81) & (x == 0x9F)) | (z == 0xE3) & (y == 0x80) & (x == 0x80)
        cut[at] = ~blank
    cut[off] = True
    # Behind a single white space that is no blank; of more, the pattern gives the last one to a piece of its own.
    at = np.flatnonzero(((kind[:-1] == LINE) | (kind[:-1] == WHITE)) & SHOWN[kind[1:]]) + 1
    cut[at] |= cut[at - 1]
    return np.flatnonzero(cut[:-1])


class Encoder:
    """Encodes texts unit by unit with a store of units seen.

    New units are encoded together, each behind a blank of its own or, those without one, each behind a newline; in the
    ids a unit begins where a token begins with that blank's mark, or behind the newline's token.
    """

    def __init__(self, path: str, specials_as_text: bool = False):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = specials_as_text
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        #: Only this kind of tokenizer never joins a blank with what stands before it; others get whole texts.
        cutter = parts.get("pre_tokenizer") or {}
        literals = [t["content"] for t in parts.get("added_tokens", [])]
        self.cuts = not any(set(x) & set(" \n") for x in literals) and parts.get("normalizer") is None and cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space", True)
        #: Strings that are a token wherever they stand; texts with one are encoded whole.
        self.literals = literals
        self.begins = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.begins[i] = token.startswith("\u0120")
        line = self.whole(["\n"])[0]
        self.line = int(line[0]) if len(line) == 1 else -1
        self.store: dict[str, int] = {}
        self.flat, self.begin, self.size = np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.int32)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def apart(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units, and how many each has; each unit has a call's item of its own."""
        lists = self.whole(units)
        return np.concatenate([np.empty(0, np.int32), *lists]), np.array([len(x) for x in lists], np.int64)

    def joined(self, units: list[str], blank: bool) -> tuple[np.ndarray, np.ndarray]:
        """As ``apart`` for units that have a blank at the front and no other, or neither a blank nor a newline."""
        parts = [(np.empty(0, np.int32), np.empty(0, np.int64))]
        for k in range(0, len(units), TOGETHER):
            some = units[k : k + TOGETHER]
            (own,) = self.whole(["".join(some) if blank else "\n" + "\n".join(some)])
            at = np.flatnonzero(self.begins[own] if blank else own == self.line)
            if len(at) != len(some):
                parts.append(self.apart(some))
            elif blank:
                parts.append((own, np.diff(at, append=len(own))))
            else:
                parts.append((np.delete(own, at), np.diff(at, append=len(own)) - 1))
        ids, sizes = zip(*parts, strict=True)
        return np.concatenate(ids), np.concatenate(sizes)

    def entries(self, units: list[str], special: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(entry of each distinct unit, ids, begin and size of each entry); new units join the store while it has room."""
        entry = np.fromiter(map(self.store.get, units, repeat(-1)), np.int32, len(units))
        new = [units[k] for k in np.flatnonzero(entry < 0).tolist()]
        kind = np.array([2 if special and any(x in u for x in self.literals) else 0 if (at := u.rfind(" ")) == 0 and "\n" not in u else 1 if at < 0 and "\n" not in u else 2 for u in new], np.int8)
        made = []
        for k in range(3):
            some = [new[i] for i in np.flatnonzero(kind == k).tolist()]
            made.append(self.apart(some) if k == 2 else self.joined(some, k == 0))
        order = np.argsort(kind, kind="stable")
        place = np.empty(len(new), np.int32)
        place[order] = np.arange(len(new), dtype=np.int32)
        entry[entry < 0] = len(self.size) + place
        flat = np.concatenate([self.flat, *(x for x, _ in made)])
        size = np.concatenate([self.size, *(x.astype(np.int32) for _, x in made)])
        begin = np.cumsum(size, dtype=np.int32) - size
        room = STORE - len(self.store)
        if room > 0 and new:
            room = min(room, len(new))
            self.store.update(zip([new[i] for i in order[:room].tolist()], range(len(self.size), len(self.size) + room), strict=True))
            n = len(self.size) + room
            self.flat, self.begin, self.size = flat[: begin[n - 1] + size[n - 1]].copy(), begin[:n].copy(), size[:n].copy()
        return entry, flat, begin, size

    def encode(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id behind it, and the offset of each text in them."""
        return self.encode_bytes(*column(pa.array(texts, pa.large_string())), end)

    def encode_bytes(self, raw: np.ndarray, off: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, of texts as bytes and their offsets.

        Units are numbered by Arrow, so Python sees each distinct one once; ids are gathered by numpy. A text that has a
        literal is one unit.
        """
        text = lambda a, z: raw[a:z].tobytes().decode("utf-8")
        if not self.cuts:
            lists = [np.append(x, np.int32(end)) for x in self.whole([text(a, z) for a, z in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)])]
            return np.concatenate([np.empty(0, np.int32), *lists]), np.cumsum([0, *(len(x) for x in lists)])
        starts = unit_starts(raw, off) if len(raw) else np.empty(0, np.int64)
        all_ = raw.tobytes()
        special = [x for x in (x.encode() for x in self.literals) if x in all_]
        if special:
            whole = np.array([any(all_.find(x, a, z) >= 0 for x in special) for a, z in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], bool)
            row = np.searchsorted(off, starts, "right") - 1
            starts = starts[~whole[row] | (starts == off[row])]
        first = np.searchsorted(starts, off)
        units = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(raw)).astype(np.int64)), pa.py_buffer(all_))
        coded = units.dictionary_encode()
        entry, flat, begin, size = self.entries(coded.dictionary.to_pylist(), bool(special))
        code = np.insert(entry[np.asarray(coded.indices)], first[1:], len(size))
        begin, flat = np.append(begin, np.int32(len(flat))), np.append(flat, np.int32(end))
        n = np.append(size, np.int32(1))[code]
        after = np.cumsum(n, dtype=np.int32)  # a run of texts has far fewer ids than 2**31
        at = np.repeat(begin[code] - (after - n), n)
        at += np.arange(len(at), dtype=np.int32)
        return flat[at], np.concatenate([[0], after[first[1:] + np.arange(len(off) - 1)]])


def encoder(path: str, specials_as_text: bool) -> Encoder:
    key = (path, specials_as_text)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def tokenise(path: str, end: int, specials_as_text: bool):
    def each(batches):
        enc = encoder(path, specials_as_text)
        for b in batches:
            ids = b.column("doc_id")
            for i, j, raw, off in pieces(b.column("text"), RUN):
                values, off = enc.encode_bytes(raw, off, end)
                tokens = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(values, pa.int32()))
                yield pa.record_batch([ids.slice(i, j - i), pa.array(np.diff(off).astype(np.int32)), tokens], ["doc_id", "n_tokens", "tokens"])
                del values, tokens
                give_back()

    return each


def write_tokens(docs: DataFrame, out: str, tokenizer: str, end: int = END, specials_as_text: bool = False, file_bytes: int = FILE_BYTES) -> None:
    """Writes (doc_id, n_tokens, tokens) to ``out`` in ascending doc_id order, file after file.

    Texts, shorter than their ids, are what the range exchange moves; ids are made where they are written. Files hold
    about ``file_bytes`` of text, and there are as many as the session has shuffle partitions at least.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(shuffle_partitions(docs.sparkSession), -(-size // file_bytes))
    ordered = docs.select("doc_id", "text").repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", F.length("text"), "text")
    rows = ordered.mapInArrow(tokenise(tokenizer, end, specials_as_text), "doc_id long, n_tokens int, tokens array<int>")
    rows.write.mode("overwrite").options(**LAYOUT).parquet(out)


def read_tokens(spark: SparkSession, out: str, doc_ids: list[int] | None = None, columns: tuple[str, ...] = ("doc_id", "n_tokens", "tokens")) -> DataFrame:
    """Selected columns and documents; page indexes and row-group statistics leave the rest of the files unread."""
    d = spark.read.schema("doc_id long, n_tokens int, tokens array<int>").parquet(out)
    return (d if doc_ids is None else d.where(F.col("doc_id").isin(doc_ids))).select(*columns)


def checksums(batches):
    for b in batches:
        lists = b.column("tokens")
        off, values = np.asarray(lists.offsets), np.ascontiguousarray(np.asarray(lists.values), "<i4").data.cast("B")
        crc = [zlib.crc32(values[4 * i : 4 * j]) for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        yield pa.record_batch([b.column("file"), b.column("place"), b.column("doc_id"), pa.array(np.diff(off).astype(np.int64)), pa.array(crc, pa.int64())], ["file", "place", "doc_id", "n_tokens", "ids_crc32"])


def summary(spark: SparkSession, out: str, scratch: Scratch) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read back from the files.

    Starts are running sums within a file plus the sums of the files before it; only a row per file meets in one task.
    """
    d = spark.read.schema("doc_id long, n_tokens int, tokens array<int>").parquet(out).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("place"), "doc_id", "tokens")
    d = scratch.save(d.mapInArrow(checksums, "file string, place long, doc_id long, n_tokens long, ids_crc32 long"), "checksums")
    files = d.groupBy("file").agg(F.sum("n_tokens").alias("all"))
    files = files.select("file", (F.sum("all").over(W.orderBy("file")) - F.col("all")).alias("before"))
    here = F.sum("n_tokens").over(W.partitionBy("file").orderBy("place").rowsBetween(W.unboundedPreceding, 0)) - F.col("n_tokens")
    return d.join(files, "file").select("doc_id", (F.col("before") + here).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, scratch: Scratch, tokenizer: str, end: int = END, specials_as_text: bool = False) -> DataFrame:
    """Writes the token files of ``docs`` (doc_id, text) in the scratch folder and returns their summary.

    Null and empty texts have the end id alone; rows that repeat a doc_id stand one after the other, shorter texts
    first; a null doc_id comes first; an empty table gives no rows. A special token's string in a text is that token, or
    ordinary text with ``specials_as_text``. Other columns are ignored.
    """
    write_tokens(docs, scratch.path("tokens"), tokenizer, end, specials_as_text)
    return summary(docs.sparkSession, scratch.path("tokens"), scratch)


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_output(documents(spark, sf_dir), Scratch(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json"))
