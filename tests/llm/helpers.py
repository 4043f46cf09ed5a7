"""Small tables and plain counterparts for the operators."""

import re

import numpy as np

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def docs(spark, texts, ids=None, sources=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", sources[k] if sources else f"s{k % 3}", len(t or "")) for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, DOCS)


def prose(seed, n, vocabulary=400):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{min(int(x), vocabulary)}" for x in rng.zipf(1.3, n))


def roots(ids, linked):
    """Smallest id reachable from each id."""
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}
