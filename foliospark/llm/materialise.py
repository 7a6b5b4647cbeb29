"""Token-ID output: training-order materialisation into fixed-stride binary shards.

Each text is tokenised and cut into sequences of ``SEQ_LEN`` tokens (the last one padded). Sequences
are numbered in the order of (hash of doc_id, doc_id, text hash, position in the text), whatever
the layout of the input; a keyed Feistel permutation with cycle walking gives each one its
global slot. Slots are cut into shards of ``SHARD_SLOTS``; each partition sorts one range of slots
and writes it as one file of records of the same size, under a temporary name that is
renamed when complete, so a lost executor or a repeated task leaves a whole file. Slot s is record
``s % SHARD_SLOTS`` of shard ``s // SHARD_SLOTS``: a reader can start at, or go on from, any slot.

Record, little-endian: doc_id int64 (the least int64 for null), sequence in the text int32, tokens
used int32, then ``SEQ_LEN`` ids of 2 bytes (4 if the vocabulary needs them), padded with 0.

Texts are tokenised twice, first for their counts only, and are never moved nor written: keys, counts and places of the
rows are ranked, and the second scan looks its numbers up by place (``places``). The first scan's tokens
could be kept instead, which takes about 0.8 of the input in disk and saves 0.3 of the CPU time.

Defined results: null and empty texts have no sequence; very long texts have as many as they need, and a unit of any
length is encoded whole; repeated rows each have theirs; nulls in doc_id are kept; other columns don't matter; an empty table writes no shard.
"""

from __future__ import annotations

import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import kept_path, save_table, settle
from . import places, words
from .ordering import order_hash, permute

#: Where each executor finds the vocabulary; ``tokenizer`` or the session's ``foliospark.tokenizer`` set another one.
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
SEQ_LEN, SHARD_SLOTS, KEY, BLOCK = 512, 16384, 77, 4 << 20
_NULL = -(1 << 63)


_CLASS = np.full(256, 2, np.int8)
_CLASS[32] = 0
for _a, _b in ((65, 91), (97, 123), (0xC3, 0xCA)):
    _CLASS[_a:_b] = 1


def _classes(data: np.ndarray) -> np.ndarray:
    """By byte: 0 blank, 1 Latin letter (U+00C0 to U+027F too), 2 anything else."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    return np.repeat(_CLASS[data[lead]], np.diff(np.append(lead, len(data))))


_KEPT = 1_000_000


@lru_cache(2)
def _tokenizer(path: str) -> tuple:
    """The model, whether texts may be cut into units, and the units met so far.

    They may if no piece has a Latin letter beside another sign, a space after another character, or
    a line break: then no merge crosses such a border, and units can be encoded one by one.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    free = sp.normalize("\ufb01  a\n") == "\u2581\ufb01\u2581\u2581a\n"
    for k in range(sp.get_piece_size()) if free else ():
        piece = sp.id_to_piece(k)
        if sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k):
            continue
        c = _classes(np.frombuffer(piece.lstrip("\u2581").encode(), np.uint8))
        if "\n" in piece or "\u2581" in piece.lstrip("\u2581") or len(set(c.tolist())) > 1:
            free = False
            break
    return sp, free, {"h": np.zeros(0, np.uint64), "at": np.zeros(0, np.int64), "n": np.zeros(0, np.int64), "ids": np.zeros(0, np.uint32)}


def tokenise(texts: list, path: str = TOKENIZER) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts, one after another, and the count of each text.

    Texts are cut into units (blanks and the letters, or the other signs, that follow); each distinct one is
    encoded once and a worker remembers some of them. The ids are those of encoding whole texts.
    """
    sp, free, known = _tokenizer(path)
    if not free:
        got = sp.encode([t or "" for t in texts], num_threads=1)
        n = np.array([len(g) for g in got], np.int64)
        return np.array([x for g in got for x in g], np.uint32), n
    odd = [k for k, t in enumerate(texts) if t and "\u2581" in t]
    if odd:  # the model's own sign for a blank: these are encoded whole
        rest = list(texts)
        for k in odd:
            rest[k] = None
        flat, n = tokenise(rest, path)
        each = np.split(flat, np.cumsum(n)[:-1])
        for k, g in zip(odd, sp.encode([texts[k] for k in odd], num_threads=1)):
            each[k], n[k] = np.array(g, np.uint32), len(g)
        return np.concatenate(each), n
    parts = [b" " + t.encode("utf-8", "replace") if t else b"" for t in texts]
    bound = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=bound[1:])
    joined = b"".join(parts) + b"\0" * 16
    c = _classes(np.frombuffer(joined, np.uint8)[: bound[-1]])
    cut = np.zeros(len(c) + 1, bool)
    cut[1:-1] = (c[1:] != c[:-1]) & ((c[1:] == 0) | (c[:-1] != 0))
    cut[bound] = True
    edges = np.flatnonzero(cut)
    starts, lens = edges[:-1], np.diff(edges)
    if not len(starts):
        return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
    distinct, first, inverse = np.unique(words.hash_spans(joined, starts, lens), return_index=True, return_inverse=True)
    where = np.searchsorted(known["h"], distinct)
    there = where < len(known["h"])
    there[there] = known["h"][where[there]] == distinct[there]
    missing = np.flatnonzero(~there)
    if len(missing):
        units = [joined[a : a + n].decode() for a, n in zip(starts[first[missing]].tolist(), lens[first[missing]].tolist())]
        own = [u[0] == " " and u != " " for u in units]  # the model puts a blank before a text: it is the unit's first one
        got = [g if o else g[2:] for o, g in zip(own, sp.encode([u[1:] if o else "\n" + u for o, u in zip(own, units)], num_threads=1))]
        n = np.array([len(g) for g in got], np.int64)
        ids = np.array([x for g in got for x in g], np.uint32)
        at = len(known["ids"]) + np.cumsum(n) - n
        known["h"], known["at"], known["n"] = (np.insert(known[k], where[missing], v) for k, v in (("h", distinct[missing]), ("at", at), ("n", n)))
        known["ids"] = np.concatenate((known["ids"], ids))
        where = np.searchsorted(known["h"], distinct)
    at, n = known["at"][where][inverse], known["n"][where][inverse]
    end = np.cumsum(n)
    flat = known["ids"][np.repeat(at - (end - n), n) + np.arange(end[-1])]
    done = np.concatenate(([0], end))[np.searchsorted(starts, bound)]
    if len(known["h"]) > _KEPT:
        known.update(h=known["h"][:0], at=known["at"][:0], n=known["n"][:0], ids=known["ids"][:0])
    return flat, np.diff(done)


def record_type(seq_len: int, width: int) -> np.dtype:
    return np.dtype([("doc_id", "<i8"), ("piece", "<i4"), ("used", "<i4"), ("tokens", f"<u{width}", (seq_len,))])


def records(ids: list, flat: np.ndarray, size: np.ndarray, seq_len: int, width: int) -> np.ndarray:
    """The records of some texts, in order."""
    n = -(-size // seq_len)
    out = np.zeros(n.sum(), record_type(seq_len, width))
    owner = np.repeat(np.arange(len(ids)), n)
    out["doc_id"] = np.array([_NULL if x is None else x for x in ids], np.int64)[owner]
    out["piece"] = np.arange(len(out)) - np.repeat(np.cumsum(n) - n, n)
    row = np.zeros(len(out) * seq_len, f"<u{width}")
    row[np.arange(len(flat)) + np.repeat((np.cumsum(n) - n) * seq_len - (np.cumsum(size) - size), size)] = flat
    out["tokens"] = row.reshape(-1, seq_len)
    out["used"] = np.minimum(seq_len, size[owner] - out["piece"] * np.int64(seq_len))
    return out


def numbers(docs: DataFrame, seq_len: int, tokenizer: str, **kw) -> tuple[str, int]:
    """Path of the answers, the number of each row's first sequence; and the count of sequences."""

    def run(batches):
        for folder, row, ids, key, texts in words.blocks(batches, BLOCK):
            n = -(-tokenise(texts, tokenizer)[1] // seq_len)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (folder, row, ids, key)), pa.array(n)], names=[places.FOLDER, places.ROW, "doc_id", "k", "n"])

    keyed = docs.select(places.FOLDER, places.ROW, "doc_id", F.xxhash64("text", "doc_id").alias("k"), "text")
    got = keyed.mapInArrow(run, f"{places.FOLDER} long, {places.ROW} long, doc_id long, k long, n long").withColumn("h", order_hash(F.col("doc_id")))
    got = places.running(got, ["h", F.col("doc_id").asc_nulls_first(), "k"], "n", **kw)
    return places.write(got, "__c"), got.agg(F.sum("n")).first()[0] or 0


def write_shards(docs: DataFrame, path: str, seq_len: int = SEQ_LEN, shard_slots: int = SHARD_SLOTS, key: int = KEY, tokenizer: str = TOKENIZER, **kw) -> DataFrame:
    """Write the shards under ``path``; the manifest: shard, file, first_slot, slots, bytes, crc."""
    docs = places.located(settle(docs, ["doc_id", "text"], [places.FOLDER, places.ROW, "_metadata"]).select("doc_id", "text")).filter("text <> ''")
    width = 2 if _tokenizer(tokenizer)[0].get_piece_size() <= 1 << 16 else 4
    base, total = numbers(docs, seq_len, tokenizer, **kw)
    stride = record_type(seq_len, width).itemsize

    def cut(batches):
        for folder, row, ids, texts in words.blocks(batches, BLOCK):
            flat, size = tokenise(texts, tokenizer)
            r, n = records(ids, flat, size, seq_len, width), -(-size // seq_len)
            start = places.lookup(base, np.array(folder, np.int64), np.array(row, np.int64))
            slot = permute(np.repeat(start, n) + r["piece"], total, key)
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(stride), len(r), [None, pa.py_buffer(r.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array((slot // shard_slots).astype(np.int32)), pa.array(slot), raw], names=["shard", "slot", "record"])

    def write(batches):
        store = crc = sink = None
        first = n = 0
        for b in batches:
            if not b.num_rows:
                continue
            slots = b.column(1).to_numpy()
            if sink is None:
                store, root = fs.FileSystem.from_uri(path)
                store.create_dir(root, recursive=True)
                first, shard = int(slots[0]), int(b.column(0)[0].as_py())
                final, temp = f"{root}/shard-{shard:08d}.bin", f"{root}/.shard-{shard:08d}-{uuid.uuid4().hex}"
                sink, crc = store.open_output_stream(temp), 0
            if not (np.array_equal(slots, np.arange(first + n, first + n + len(slots))) and first % shard_slots == 0):
                raise ValueError("slots aren't consecutive")
            data = b"".join(b.column(2).to_pylist())
            sink.write(data)
            crc, n = zlib.crc32(data, crc), n + len(slots)
        if sink is not None:
            sink.close()
            if store.get_file_info(final).type != fs.FileType.NotFound:
                store.delete_file(final)
            store.move(temp, final)
            yield pa.RecordBatch.from_pylist([{"shard": shard, "file": final.rsplit("/", 1)[1], "first_slot": first, "slots": n, "bytes": n * stride, "crc": crc}], schema=_MANIFEST)

    rows = docs.select(places.FOLDER, places.ROW, "doc_id", "text").mapInArrow(cut, "shard int, slot long, record binary")
    rows = rows.repartitionById(max(1, -(-total // shard_slots)), F.col("shard")).sortWithinPartitions("slot")
    return save_table(rows.mapInArrow(write, "shard int, file string, first_slot long, slots long, bytes long, crc long"), "manifest")


_MANIFEST = pa.schema([("shard", pa.int32()), ("file", pa.string()), ("first_slot", pa.int64()), ("slots", pa.int64()), ("bytes", pa.int64()), ("crc", pa.int64())])


def read_slots(path: str, start: int, count: int, seq_len: int = SEQ_LEN, shard_slots: int = SHARD_SLOTS, width: int = 2) -> np.ndarray:
    """``count`` records from slot ``start`` on, by seeking; fewer at the end."""
    store, root = fs.FileSystem.from_uri(path)
    kind, out = record_type(seq_len, width), []
    while count > 0:
        name = f"{root}/shard-{start // shard_slots:08d}.bin"
        if store.get_file_info(name).type == fs.FileType.NotFound:
            break
        with store.open_input_file(name) as f:
            f.seek(start % shard_slots * kind.itemsize)
            part = np.frombuffer(f.read(min(count, shard_slots - start % shard_slots) * kind.itemsize), kind)
        if not len(part):
            break
        out.append(part)
        start, count = start + len(part), count - len(part)
    return np.concatenate(out) if out else np.zeros(0, kind)


def read_shards(manifest: DataFrame, path: str, seq_len: int = SEQ_LEN, shard_slots: int = SHARD_SLOTS, width: int = 2) -> DataFrame:
    """(slot, shard, doc_id, piece, tokens) of the shards in the manifest, read in sequence."""

    def run(batches):
        for b in batches:
            for shard, first, n in zip(*(b.column(c).to_pylist() for c in range(3))):
                for at in range(first, first + n, 4096):
                    r = read_slots(path, at, min(4096, first + n - at), seq_len, shard_slots, width)
                    used = r["used"].astype(np.int64)
                    mask = np.arange(seq_len) < used[:, None]
                    tokens = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(used))).astype(np.int32)), pa.array(r["tokens"][mask].astype(np.int32)))
                    doc = pa.array(r["doc_id"], mask=r["doc_id"] == _NULL)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(r))), pa.array([shard] * len(r), pa.int32()), doc, pa.array(r["piece"]), tokens], names=["slot", "shard", "doc_id", "piece", "tokens"])

    n = max(1, manifest.count())
    return manifest.select("shard", "first_slot", "slots").repartition(n, "shard").mapInArrow(run, "slot long, shard int, doc_id long, piece int, tokens array<int>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the documents' shards to the shared folder and read them back, slot by slot."""
    path = kept_path(spark, "shards", uuid.uuid4().hex)
    tokenizer = spark.conf.get("foliospark.tokenizer", TOKENIZER)
    manifest = write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, tokenizer=tokenizer)
    return read_shards(manifest, path)
