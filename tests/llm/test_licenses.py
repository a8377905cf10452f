"""Labels and scores of the license scan against hits looked for one by one."""
import random
import re

import pytest

from courtside.llm import licenses

from ..conftest import SMALL


def _labels(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
    found, score = set(), 0.0
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        if any(words[i : i + len(p)] == p for i in range(len(words))):
            found.add(label)
            score = 1.0
    k = licenses.LONG
    for label, notice in licenses.NOTICES.items():
        t = notice.split()
        hits = sorted((i - pos, i, pos) for pos in range(len(t) - k + 1) for i in range(len(words) - k + 1) if words[i : i + k] == t[pos : pos + k])
        clusters = []
        for d, i, pos in hits:
            if not clusters or d - clusters[-1][-1][0] > licenses.NEAR:
                clusters.append([])
            clusters[-1].append((d, i, pos))
        for c in clusters:
            cover = len({pos for _, _, pos in c}) / (len(t) - k + 1)
            if cover >= licenses.LEAST_COVER and max(i for _, i, _ in c) - min(i for _, i, _ in c) + k <= len(t) * licenses.STRETCH:
                found.add(label)
                score = max(score, cover)
    return sorted(found), score


def _texts():
    rng = random.Random(4)
    out = []
    for t in licenses.NOTICES.values():
        words = t.split()
        for _ in range(12):
            own = [w for w in words if rng.random() > 0.06]
            for _ in range(rng.randint(0, 4)):
                own.insert(rng.randrange(len(own)), "more")
            out.append("before it " + " ".join(own[rng.randint(0, 12) :]))
        # one stretch said again and again is not the notice
        out.append(" ".join(words[:7] * 9))
        out.append(" ".join((words[:9] + ["x"]) * 6))
        out.append(t + " and then " + t)
    return out


def test_labels_and_scores(spark):
    texts = _texts()
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        labels, score = _labels(text)
        assert (list(got[i].labels), got[i].score) == (labels, pytest.approx(score)), text
    assert any(not r.labels for r in got.values())


def test_labels_of_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: (list(r.labels), r.score) for r in licenses.scan(docs).collect()}
    for d, text in docs.collect():
        labels, score = _labels(text)
        assert got[d] == (labels, pytest.approx(score))
