import random
import zlib

import numpy as np

from foliospark.llm import materialise as m
from foliospark.llm import ordering
from tests.llm.helpers import awkward, bare, docs, empty, prose
from tests.llm.test_order import py_hash


def plain(texts):
    return m._tokenizer(m.TOKENIZER)[0].encode([t or "" for t in texts], num_threads=1)


def test_units_give_the_ids_of_whole_texts(monkeypatch):
    r = random.Random(3)
    signs = ["a", "Zed", "é", "ß", "日本", "😀", " ", "  ", "   ", "\n", "\n\n", "\t", ".", ",", "...", "(x)", "$$$", "12", "3a", "'s", "▁", "-", "\0", "<s>", "“q”"]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 40))) for _ in range(600)] + [None, "", " ", "\n", " a", "a "]
    assert m._tokenizer(m.TOKENIZER)[1]
    for kept in (10**6, 5):
        monkeypatch.setattr(m, "_KEPT", kept)
        for lo in range(0, len(texts), 200):
            flat, n = m.tokenise(texts[lo : lo + 200])
            assert [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])] == plain(texts[lo : lo + 200])


def test_round_trip_and_resume(spark, tmp_path):
    r = random.Random(1)
    texts = [prose(r, r.randint(1, 90)) for _ in range(40)]
    path = f"file://{tmp_path}/shards"
    manifest = m.write_shards(docs(spark, texts).repartition(3), path, seq_len=16, shard_slots=10)
    tokens = plain(texts)
    n = [-(-len(t) // 16) for t in tokens]
    total = sum(n)
    rows = sorted(m.read_shards(manifest, path, 16, 10).collect(), key=lambda x: x.slot)
    assert [x.slot for x in rows] == list(range(total))
    by = {}
    for x in rows:
        by.setdefault(x.doc_id, {})[x.piece] = x
    assert all(sum((by[k][p].tokens for p in range(n[k])), []) == tokens[k] for k in range(40))
    start = 0
    for k in sorted(range(40), key=lambda i: (py_hash(i, 0), i)):
        assert [by[k][p].slot for p in range(n[k])] == ordering.permute(np.arange(start, start + n[k]), total, m.KEY).tolist()
        start += n[k]
    for f in manifest.collect():
        data = (tmp_path / "shards" / f.file).read_bytes()
        assert len(data) == f.bytes == f.slots * m.record_type(16, 2).itemsize and zlib.crc32(data) == f.crc
    part = m.read_slots(path, 17, 11, 16, 10)
    assert [(int(a), int(b)) for a, b in zip(part["doc_id"], part["piece"])] == [(x.doc_id, x.piece) for x in rows[17:28]]
    assert len(m.read_slots(path, total - 2, 50, 16, 10)) == 2
    assert sorted(p.name for p in (tmp_path / "shards").iterdir() if p.suffix == ".bin") == [f"shard-{k:08d}.bin" for k in range(-(-total // 10))]
    again = m.write_shards(docs(spark, texts).repartition(7), path, seq_len=16, shard_slots=10, range_rows=6, limit=0)
    assert sorted(x.crc for x in again.collect()) == sorted(x.crc for x in manifest.collect())


def test_awkward_rows(spark, tmp_path):
    df, path = awkward(spark, ("k0", "start")), f"file://{tmp_path}/s"
    manifest = m.write_shards(df, path, seq_len=8, shard_slots=64)
    rows = m.read_shards(manifest, path, 8, 64).collect()
    want = sum(-(-len(t) // 8) for t in plain([x.text for x in bare(df).collect()]))
    assert len({x.slot for x in rows}) == len(rows) == want
    assert sum(x.doc_id == 3 for x in rows) == 2 and any(x.doc_id is None for x in rows)
    assert m.write_shards(empty(spark), path + "e").count() == 0
    long = docs(spark, ["x" * 300_000, "y" * 1_000_000])
    assert m.write_shards(long, path + "l").agg({"slots": "sum"}).first()[0] == sum(-(-len(t) // m.SEQ_LEN) for t in plain(["x" * 300_000, "y" * 1_000_000]))
