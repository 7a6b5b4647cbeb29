"""Model-backed columns with a pluggable model and a deterministic default."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cells import mapped

_STOP = {
    "en": "the of and to in is that it was for on are as with they at be this have from or by but not".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más".split(),
}


def guess_language(text: str | None) -> str:
    """Language with the most function words; unknown without any."""
    words = Counter(re.findall(r"\w+", (text or "").lower()))
    score = {k: sum(words[w] for w in v) for k, v in _STOP.items()}
    best = max(score, key=lambda k: (score[k], k))
    return best if score[best] else "unknown"


def language(text: str, detect: Callable[[str | None], str] = guess_language) -> Column:
    return mapped(detect, T.StringType(), text)


def guess_block(text: str | None) -> str:
    """Label of a text block: address if it has a postal code line or contact words, else unknown."""
    t = text or ""
    postal = re.search(r"\b\d{4,6}\s+[A-ZÄÖÜ][\w-]+|\b[A-Z]{2}\s+\d{5}\b", t)
    contact = re.search(r"(?i)\b(?:tel|phone|fax|mail|street|straße|strasse|avenue|road|calle|rue)\b", t)
    return "address" if postal and (contact or "\n" in t) else "unknown"


def label_blocks(df: DataFrame, text: str = "text", classify: Callable[[str | None], str] = guess_block) -> DataFrame:
    """``df`` with ``labels``, an array of one label for each block."""

    return df.withColumn("labels", mapped(lambda x: [classify(x)], T.ArrayType(T.StringType()), text))


def addresses(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    return blocks.filter(F.array_contains("labels", "address")).groupBy(key).agg(F.array_sort(F.collect_list("text")).alias("addresses"))


def overlap_scores(text: str | None, labels: Sequence[str]) -> dict[str, float]:
    """Share of a label's letter trigrams that the text has: the default zero-shot score."""
    grams = lambda s: {s[i : i + 3] for i in range(len(s) - 2)}
    t = (text or "").lower()
    return {x: round(sum(g in t for g in grams(x.lower())) / max(1, len(grams(x.lower()))), 6) for x in labels}


def zero_shot(text: str, labels: Sequence[str], scorer: Callable[[str | None, Sequence[str]], dict] = overlap_scores) -> Column:
    """Score of each label as a map."""
    labels = list(labels)
    return mapped(lambda x: scorer(x, labels), T.MapType(T.StringType(), T.DoubleType()), text)


def answer_windows(text: Column, size: int = 400, overlap: int = 50) -> Column:
    """Overlapping windows of words."""
    w = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    starts = F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(size - overlap))
    return F.transform(starts, lambda k: F.array_join(F.slice(w, k + 1, size), " "))


def extract_answers(question: str, text: str | None, k: int = 5, max_words: int = 5) -> list[tuple[str, float]]:
    """Spans of at most five words next to question words: (answer, score), best first."""
    stop = set().union(*map(set, _STOP.values())) | {"what", "who", "where", "when", "which", "how", "why"}
    wanted = {w for w in re.findall(r"\w+", question.lower()) if w not in stop}
    toks = re.findall(r"\w+", text or "")
    low = [t.lower() for t in toks]
    hits = [i for i, t in enumerate(low) if t in wanted]
    found: dict[str, float] = {}
    for i in hits:
        for n in range(1, max_words + 1):
            for s in (i + 1, i - n):
                if 0 <= s and s + n <= len(toks) and not wanted & set(low[s : s + n]):
                    span = " ".join(toks[s : s + n])
                    if len(span) <= 100:
                        near = sum(1 / (1 + min(abs(h - s), abs(h - s - n + 1))) for h in hits if abs(h - s) < 30)
                        content = sum(t not in stop for t in low[s : s + n]) / n
                        found[span] = max(found.get(span, 0.0), round(near * content, 6))
    return sorted(found.items(), key=lambda x: (-x[1], x[0]))[:k]


def answers(df: DataFrame, questions: Sequence[str], text: str = "text", model: Callable[..., list[tuple[str, float]]] = extract_answers) -> DataFrame:
    """``df`` with ``answers``: for each question a list of (answer, score), best first."""
    questions = list(questions)
    kind = T.ArrayType(T.ArrayType(T.StructType([T.StructField("answer", T.StringType()), T.StructField("score", T.DoubleType())])))
    one = lambda t: [[{"answer": a, "score": float(b)} for a, b in model(q, t)] for q in questions]
    return df.withColumn("answers", mapped(one, kind, text))


PROMPT = ("# Instruction: below is a question, a task or a conversation; write a fitting answer.\n\n## Prompt:\n\n", "\n\n## Input:\n\n", "\n\n## Result:\n\n")


def prompt(task: str, data: Column) -> Column:
    """Prompt for a task over data, as a native column."""
    return F.concat(F.lit(PROMPT[0] + task + PROMPT[1]), data, F.lit(PROMPT[2]))


def chat(df: DataFrame, tasks: str | Sequence[str], data: Column, client: Callable[[str], str], cache: DataFrame | None = None) -> DataFrame:
    """(…, task, prompt, key, answer) for each task: answers come from a cache table by the prompt's
    sha2 first, each other distinct prompt is asked once."""
    tasks = [tasks] if isinstance(tasks, str) else list(tasks)
    asked = df.withColumn("_data", data).withColumn("task", F.explode(F.array(*[F.lit(t) for t in tasks])))
    head, mid, end = PROMPT
    asked = asked.withColumn("prompt", F.concat(F.lit(head), "task", F.lit(mid), "_data", F.lit(end))).withColumn("key", F.sha2("prompt", 256)).drop("_data")

    @F.pandas_udf(T.StringType())
    def ask(s: pd.Series) -> pd.Series:
        return s.map(client)

    need = asked.select("key", "prompt").distinct()
    if cache is not None:
        need = need.join(cache.select("key"), "key", "left_anti")
    got = need.select("key", ask("prompt").alias("answer"))
    if cache is not None:
        got = got.unionByName(cache.select("key", "answer"))
    return asked.join(got, "key", "left")


def train_block_classifier(df: DataFrame, features: list[str], label: str, weight: str | None = None):
    """Pipeline model: indexed label, assembled features, weighted logistic regression."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler

    lr = LogisticRegression(featuresCol="scaled", labelCol="_label", maxIter=30, regParam=0.01)
    if weight:
        lr = lr.setWeightCol(weight)
    return Pipeline(stages=[StringIndexer(inputCol=label, outputCol="_label", handleInvalid="keep"), VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep"), StandardScaler(inputCol="_x", outputCol="scaled"), lr]).fit(df)


def vector_of(text: Column, embed: Callable[[list], object] | None = None) -> Column:
    """Vector of a text."""
    from .vectors import hashing_vectors

    run_ = embed or hashing_vectors

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([v.astype("float32") for v in run_(s.tolist())])

    return F.when(text.isNotNull(), run(text))


def vectors_of(texts: Column, embed: Callable[[list], object] | None = None) -> Column:
    """Vectors of the texts of an array, in one call for a whole batch."""
    from .vectors import hashing_vectors

    run_ = embed or hashing_vectors

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.FloatType())))
    def run(s: pd.Series) -> pd.Series:
        lists = [[] if x is None else list(x) for x in s]
        flat = run_([t for x in lists for t in x]) if any(map(len, lists)) else []
        out, at = [], 0
        for x in lists:
            out.append([v.astype("float32") for v in flat[at : at + len(x)]])
            at += len(x)
        return pd.Series(out)

    return run(texts)


def labels_of(texts: Column, classify: Callable[[str | None], str] = guess_block) -> Column:
    """Label of each text of an array."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [] if x is None else [classify(t) for t in x])

    return run(texts)
