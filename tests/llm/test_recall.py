"""Recall of planted copies of benchmark items, by the kind of change; short items in very long documents."""

import random
import re
import time

import pytest

from helixflow.llm import decontaminate

NAMES = ["Anna", "Boris", "Clara", "Dmitri", "Elena", "Farid", "Greta", "Hugo"]
WORDS = "the farmer sells some of her best apples to a market near old town where people wait under bright lamps and count every coin before rain comes over hills while children play with wooden boats in cold water until bells ring".split()


def items(draw, n=40):
    out = []
    for i in range(n):
        words = [draw.choice(WORDS) for _ in range(draw.randrange(18, 40))]
        for at in draw.sample(range(3, len(words)), 3):
            words[at] = draw.choice([str(draw.randrange(2, 99)), draw.choice(NAMES), f"{draw.randrange(2, 99)} kg"])
        out.append((i, " ".join(words) + "?"))
    return out


def other_numbers(draw, text):
    new = {}
    return re.sub(r"\d+", lambda m: new.setdefault(m[0], str(draw.randrange(100, 999))), text)


def other_names(draw, text):
    new = dict(zip(NAMES, draw.sample(["Ivan", "Jutta", "Karim", "Lena", "Mauro", "Nadia", "Oskar", "Petra"], 8), strict=True))
    return re.sub(r"[A-Z]\w+", lambda m: new.get(m[0], m[0]), text)


def edited(draw, text):
    words = text.split()
    for at in draw.sample(range(len(words)), 1 + len(words) // 20):
        words[at] = "indeed"
    return " ".join(words)


CHANGES = {
    "verbatim": lambda d, t: t, "lower": lambda d, t: t.lower(), "upper": lambda d, t: t.upper(), "title": lambda d, t: t.title(), "space": lambda d, t: t.replace(" ", " \n "),
    "numbers": other_numbers, "names": other_names, "one number": lambda d, t: re.sub(r"\d+", "7", t), "edited": edited,
}


def test_recall_of_planted_copies(spark):
    draw = random.Random(9)
    bench = items(draw)
    docs, planted = [], {}
    filler = lambda: " ".join(draw.choice(WORDS) for _ in range(draw.randrange(0, 300)))
    for kind, change in CHANGES.items():
        for item, text in bench:
            planted[len(docs)] = (kind, item)
            docs.append((len(docs), f"{filler()}. {change(draw, text)} {filler()}"))
    clean = len(docs)
    docs += [(len(docs) + k, filler()) for k in range(200)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(d, spark.createDataFrame(bench, "item_id long, text string")).collect()}
    recall = {k: sum((i, item) in found for i, (kind, item) in planted.items() if kind == k) / len(bench) for k in CHANGES}
    print(recall)
    assert min(recall.values()) >= 0.9 and all(recall[k] == 1.0 for k in ("verbatim", "lower", "upper", "title", "space"))
    assert not [i for i, _ in found if i >= clean]


def test_short_items_in_long_documents(spark):
    """Linear in the document's words; short items match in any case."""
    bench = spark.createDataFrame([(1, "Open Sesame"), (2, "take 7 Doors")], "item_id long, text string")
    rows = [(1, " ".join(f"w{i}x" for i in range(60_000)) + " open sesame"), (2, "TAKE 7 DOORS and go"), (3, "take 8 doors"), (4, "he said Open Sesame")]
    began = time.time()
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {(1, 1), (2, 2), (4, 1)} and time.time() - began < 60


@pytest.mark.parametrize("asked,hit", [("A box has 3 red and 3 blue balls, so how many balls are in this box now", True), ("A box has 9 red and 4 blue balls, so how many balls are in this box now", True), ("A jar has many balls, so how many are red or blue is not known to us", False)])
def test_values_may_become_equal(spark, asked, hit):
    b = spark.createDataFrame([(1, "A box has 6 red and 8 blue balls, so how many balls are in this box now")], "item_id long, text string")
    assert decontaminate.find_leaks(spark.createDataFrame([(1, asked)], "doc_id long, text string"), b).count() == int(hit)
