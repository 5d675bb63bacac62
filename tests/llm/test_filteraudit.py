"""The filter audit against a document-by-document version, and its cases of nulls, ties and repeated rows."""

import re
from collections import Counter
from itertools import permutations

from rankflow.llm import filteraudit

LONG = " ".join(f"w{i}" for i in range(200))
TEXTS = [
    LONG, LONG + " #", LONG, "a " * 199, "a " * 200, LONG.upper(), "", None, "\x0b\x1c  ", "B" * 3 + "x" * 97, "B" * 4 + "x" * 96, "é|è", LONG + "\r\nX",
    " ".join(["a"] * 100 + [f"v{i}" for i in range(99)]), " ".join(["a"] * 101 + [f"v{i}" for i in range(99)]), " ".join(["a"] * 102 + [f"v{i}" for i in range(99)]),
]


def brute(rows, labels):
    def fails(doc, text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        first = min((d is not None, d or 0) for d, t, _ in rows if (t or "") == text)
        return "".join(
            x for x, bad in zip("ABCDE", [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search("[#$%&*|]", text)), (doc is not None, doc or 0) > first]) if bad
        )

    own = [(lang or "", fails(doc, text or ""), doc) for doc, text, lang in rows]
    said = lambda doc, k: any(row[0] == doc and row[k] == 1 for row in labels if doc is not None)
    out, shapley = Counter(), Counter()
    for part in {p for p, _, _ in own}:
        for order in permutations("ABCDE"):
            for step, x in enumerate(order, 1):
                here = [(f, doc) for p, f, doc in own if p == part and x in f]
                removed = [(f, doc) for f, doc in here if not set(f) & set(order[: step - 1])]
                kept = sum(p == part and not set(f) & set(order[:step]) for p, f, _ in own)
                shapley[part, x] += len(removed)
                out[part, "".join(order), step] = (kept, len(removed), len(here) - len(removed), sum(f == x for f, _ in here), sum(said(d, 1) for _, d in removed), sum(said(d, 2) for _, d in removed))
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit(spark):
    rows = [(i, text, [None, "", "en", "de"][i % 4]) for i, text in enumerate(TEXTS * 3)] + [(None, LONG, "en"), (None, None, "fr"), (7, None, "en"), (7, None, "en"), (100, "x", "en"), (100, "x", "de"), (101, "x", "de")]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 40, 2)] + [(3, None, 1), (3, 1, None), (5, 2, 2), (None, 1, 1)]
    docs = spark.createDataFrame([(d, t, x, 1, "y") for d, t, x in rows], "doc_id long, text string, lang string, quality int, part string")
    marks = spark.createDataFrame([(d, q, None if t is None else int(t)) for d, q, t in labels], "doc_id long, quality int, toxic int")
    got = filteraudit.audit(docs.repartition(3), marks, "lang").collect()
    assert {(r.part, r.filter_order, r.step): tuple(r[m] for m in filteraudit.MEASURES) for r in got} == brute(rows, labels)
    assert len(got) == 4 * 600  # en, de, fr and the two blank ones as one part; zeros included


def test_parts_flushed_in_between(monkeypatch):
    batches = [filteraudit.pa.RecordBatch.from_pydict({"part": ["a", "b", "a"], "mask": [0, 3, 1], "good": [0, 1, 0], "toxic": [0, 0, 1], "n": [5, 1, 2]})]
    whole = list(filteraudit._removals(batches))
    monkeypatch.setattr(filteraudit, "PARTS_HELD", 1)
    parts = list(filteraudit._removals(batches))
    total = lambda out: Counter({(p, o, s): r for b in out for p, o, s, r in zip(*(b.column(c).to_pylist() for c in ("part", "filter_order", "step", "removed"))) if r})
    assert len(parts) > len(whole) == 1 and total(parts) == total(whole)


def test_empty_table(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filteraudit.audit(docs, labels, "lang").collect() == []
