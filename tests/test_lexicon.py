import random
import re

import pytest

from causeway.operators import frames
from causeway.operators import lexicon as L
from tests.conftest import rows

CONCEPTS = {"A": ("alpha",), "B": ("beta", "bravo"), "C": ("gamma",)}
MARKERS = (r"\bso\b", r"\bdue to\b")


def corpus(seed, files=3, n=60):
    rnd = random.Random(seed)
    out = []
    for f in range(files):
        for i in range(1, n + 1):
            text = " ".join(rnd.choice(["alpha", "bravo", "gamma", "so", "due to", "filler", "words", "here"]) for _ in range(rnd.randint(0, 6)))
            text = text + " padding padding padding padding padding." if rnd.random() < 0.9 else text
            page = None if rnd.random() < 0.1 else i // 4
            out.append((f"f{f}", i, page, rnd.choice(["s", "t", None]), None, text if rnd.random() < 0.95 else None))
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "file STRING, lineno INT, page INT, section STRING, subsection STRING, text STRING")


def surviving(data):
    by = {}
    for r in data:
        if r[5] is not None and len(r[5].strip()) >= 40:
            by.setdefault(r[0], []).append(r)
    return by


def mask(text):
    return {k for k, ps in CONCEPTS.items() if any(re.search(p, text, re.I) for p in ps)}


def marks(text):
    return re.findall("|".join(MARKERS), text, re.I)


def brute_windows(data, most_rows, most_pages):
    out = []
    for file, rs in surviving(data).items():
        for i, first in enumerate(rs):
            if not mask(first[5]):
                continue
            for size in range(2, most_rows + 1):
                w = rs[i : i + size]
                if len(w) < size:
                    break
                pages = [r[2] for r in w if r[2] is not None]
                if pages and max(pages) - min(pages) > most_pages:
                    continue
                if set().union(*(mask(r[5]) for r in w)) != set(CONCEPTS) or not mask(w[-1][5]) or sum(bool(marks(r[5])) for r in w) < 2:
                    continue
                out.append((file, first[1], w[-1][1], size))
                break
    return sorted(out, key=repr)


def test_smallest_windows_against_brute_force(spark, monkeypatch):
    for block in (7, 4096):
        monkeypatch.setattr(frames.in_blocks, "__defaults__", (block,))
        data = corpus(block)
        got = L.smallest_windows(L.scan(frame(spark, data), CONCEPTS, MARKERS), CONCEPTS, 9, 2)
        assert rows(got.select("file", "start_line", "end_line", "n_rows")) == brute_windows(data, 9, 2)


def test_anchored_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(frames.in_blocks, "__defaults__", (5,))
    data = corpus(3)
    want = []
    for file, rs in surviving(data).items():
        for i, r in enumerate(rs):
            near = rs[max(0, i - 4) : i + 5]
            pages = [x[2] for x in near if x[2] is not None]
            total = sum(len(marks(x[5])) for x in near)
            if "A" in mask(r[5]) and set().union(*(mask(x[5]) for x in near)) == set(CONCEPTS) and total >= 3 and (not pages or max(pages) - min(pages) <= 2):
                want.append((file, r[1], total))
    got = L.anchored(L.scan(frame(spark, data), CONCEPTS, MARKERS, head_of="A"), CONCEPTS, "A", 4, 3, 2)
    assert rows(got.select("file", "anchor_line", "total_markers")) == sorted(want, key=repr)
    assert sum(r[1] for r in rows(L.per_file(got))) == len(want)


def test_number_rows_with_small_buckets(spark):
    df = spark.createDataFrame([("a", i * 3, i) for i in range(50)] + [(None, 1, 1), (None, 1, 2)], "g STRING, o INT, t INT")
    got = frames.number_rows(df, "g", "o", "t", bucket=7)
    assert all(r.rn == r.t + 1 for r in got.where("g = 'a'").collect())
    assert rows(got.where("g IS NULL").select("t", "rn")) == [(1, 1), (2, 2)]


def test_relaxed_reads_over_row_borders(spark):
    pad = " padding padding padding padding padding"
    data = [("f", 1, 1, None, None, "alpha so" + pad + " climate"), ("f", 2, 1, None, None, "change bravo so" + pad), ("skipped", 1, 1, None, None, "alpha")]
    concepts = {"A": ("alpha",), "B": ("bravo",), "X": ("climate change",)}
    got = L.relaxed(frame(spark, data), concepts, MARKERS, reach=1, least_markers=2)
    assert rows(got.select("file", "anchor_line", "marker_count")) == [("f", 1, 2), ("f", 2, 2)]
    skip = spark.createDataFrame([("f",)], "file STRING")
    assert L.relaxed(frame(spark, data), concepts, MARKERS, 1, 2, skip=skip).count() == 0
    assert rows(L.collapse_anchors(got).select("file", "anchor_line")) == [("f", 1)]


def test_prefilter_and_default_lexicon(spark):
    text = "Board oversight of scope 1 emissions led to higher shareholder value, driven by the plan."
    df = frame(spark, [("f", 1, 1, None, None, text), ("f", 2, 1, None, None, "short scope 1"), ("f", 3, 1, None, None, None)])
    got = L.prefilter(df).collect()
    assert [(r.lineno, r.nodes, r.score) for r in got] == [(1, ["CG", "GHG", "MBV"], 35)]
    # the shorter alternative comes first in the list
    assert got[0].causal_markers == ["driven", "led to"]
    assert L.prefilter(df.limit(0)).count() == 0 and L.smallest_windows(L.scan(df.limit(0))).count() == 0


@pytest.mark.parametrize("patterns", [("climate change",), ("climate .*change",)])
def test_relaxed_against_brute_force(spark, monkeypatch, patterns):
    """Phrases split between rows, islands over several blocks; a pattern without bound is read in whole neighbourhoods."""
    monkeypatch.setattr(frames.in_blocks, "__defaults__", (5,))
    rnd = random.Random(4)
    words = ["alpha", "bravo", "so", "climate", "change", "therefore", "padding"] + ["filler"] * 6
    data = [(f, n, n // 6, None, None, " ".join(rnd.choice(words) for _ in range(9)) + " climate"[: 8 * (n % 2)]) for f in "fg" for n in range(40)]
    concepts, markers = {"A": ("alpha",), "B": ("bravo",), "X": patterns}, (r"\bso\b", r"\btherefore\b", r"climate change so\b")
    want, islands = [], []
    for file in "fg":
        rs = [r for r in data if r[0] == file and len(r[5].strip()) >= 40]
        last = None
        for i, r in enumerate(rs):
            near = rs[max(0, i - 2) : i + 3]
            around = " ".join(x[5] for x in near)
            n = len(re.findall("|".join(markers), around, re.I))
            if near[-1][2] - near[0][2] <= 1 and n >= 3 and all(re.search(p, around, re.I) for ps in concepts.values() for p in ps):
                want.append((file, r[1], n))
                if last is None or i - last > 3:
                    islands.append([])
                islands[-1].append((-n, i, file, r[1]))
                last = i
    got = L.relaxed(frame(spark, data), concepts, markers, reach=2, least_markers=3, most_pages=1)
    assert rows(got.select("file", "anchor_line", "marker_count")) == sorted(want, key=repr) and len(want) > 5
    best = sorted(min(x)[2:] for x in islands)
    assert sorted(map(tuple, L.collapse_anchors(got, 3).select("file", "anchor_line").collect())) == best
    plan = L.smallest_windows(L.scan(frame(spark, data), concepts, markers), concepts)._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.split("\n") if "Window" in x and "text#" in x]
