import random

import corpus_pipeline
from foliospark.llm import decontaminate, mixing, neardup, ordering, sharding
from tests.llm.helpers import DOCS, docs, prose
from tests.llm.test_decontaminate import greedy
from tests.llm.test_neardup import brute
from tests.llm.test_order import brute_mix, py_hash
from tests.llm.test_toxicity import corpus


def test_pipeline_against_brute_force(spark, tmp_path):
    r = random.Random(11)
    texts, toxic = corpus(80, 5)
    items = [prose(r, 25) for _ in range(3)]
    texts += [prose(r, 40) + " " + items[0] + " " + prose(r, 10), items[1]]
    w = texts[1].split()
    w[3] = "edited"
    texts += [" ".join(w), texts[2]]
    sources = [r.choice("abc") for _ in texts]
    docs(spark, texts, sources=sources).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(x)) for k, x in enumerate(toxic)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]

    kept = [k for k in range(len(texts)) if k >= 80 or not toxic[k]]
    gone = {a for a, _ in brute([texts[k] for k in kept], kept)}
    assert {82, 83} <= gone
    kept = [k for k in kept if k not in gone]
    toks = lambda t: t.replace(",", " ").replace(".", " ").split()
    kept = [k for k in kept if all(sum(x[2] for x in greedy(toks(i), toks(texts[k]), decontaminate.MIN_MATCH)) < decontaminate.COVERAGE * len(toks(i)) for i in items)]
    assert not {80, 81} & set(kept)
    mixed = brute_mix([(k, texts[k], sources[k]) for k in kept], mixing.STEPS, mixing.START, mixing.END, mixing.SEED)
    ids = sorted((m[0] for m in mixed), key=lambda k: (py_hash(k, 0), k))
    slots = ordering.permute(__import__("numpy").arange(len(ids)), len(ids), sharding.KEY)
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((x.doc_id, x.slot) for x in rows) == sorted(zip(ids, slots.tolist()))
    assert all(x.text == texts[x.doc_id] and x.shard == x.slot // sharding.SHARD_ROWS for x in rows)
    assert neardup.THRESHOLD == 0.5 and DOCS.names == rows[0].__fields__[:5]
