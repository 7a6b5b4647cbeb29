import random

import numpy as np

from foliospark.llm import lm
from tests.llm.helpers import docs, prose
from tests.llm.test_lm import brute


def test_default_is_trigrams_learned_from_all_documents_of_a_small_table(spark):
    r = random.Random(8)
    texts = [prose(r, r.randint(5, 40)) for _ in range(12)]
    want = brute(texts, 3, 1000)
    got = {x.doc_id: x for x in lm.score(docs(spark, texts), held=0).collect()}
    assert np.allclose([got[k].log2_prob for k in range(len(texts))], [s for _, s in want])
