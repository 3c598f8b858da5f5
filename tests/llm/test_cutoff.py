import random

import pytest
from pyspark.sql import functions as F

from causeway.llm import cutoff as C
from tests.conftest import rows

ENTRIES = ["Board Oversight", "Carbon Output"]
WHOLE = [
    "It ends.", "It ends!", 'It says "so followed".', "FINAL: A -> Carbon Output", "FINAL: A → **Board Oversight**.", "It ends. ✅", "So it stands (see the second sentence).",
    "It ends.   ", "Is it so?", "FINAL: A -> something typed freely",
]
CLOSINGS = ["Done", "Text.\n---", "Text.\n</analysis>", "a\n```\nBoard Oversight\n```", "- cause: x\n- effect: Board Oversight", "So I write it down…"]
CUT = [
    "It en", "The list has banks, incl.", "Compare with fig.", "They name levers, i.e.", "- cause: x", "- cause: x\n- effect:", "- cause: x\n- effect: Board Ov", "a\n```\nBoard", "FINAL: A ->", "FINAL: A -> Carb",
    "Text.\n-", "the valu...", "it sta…", "and, ", "It is �", "- cause: Board Oversight",
]


def frame(spark, data):
    return spark.createDataFrame(data, "row_id BIGINT, model STRING, raw_thinking STRING, closing INT")


def test_contexts(spark):
    texts = WHOLE + CUT + [f"{'x' * i} {t}" if "\n" in t else t for t in CLOSINGS for i in range(60)] + [None, "", " \n"]
    got = {r.row_id: r.evidence for r in C.cut_values(frame(spark, [(i, f"m{i}", t, 1) for i, t in enumerate(texts)]), ENTRIES).collect()}
    n = len(WHOLE)
    assert [texts[i] for i in range(n) if got[i]] == [] and [texts[i] for i in range(n, n + len(CUT)) if not got[i]] == []
    assert all(got[i] is None for i in range(n + len(CUT), len(texts) - 3)) and len(got) == len(texts) - 3


def limited(unit, limit=200):
    """Values of model m cut at a limit, some of them all alike; values of another model without limit."""
    rnd = random.Random(1)
    data = []
    for i in range(600):
        text = "".join(rnd.choice("abcdé ") for _ in range(rnd.randint(20, 400))) + "."
        if i % 5 == 0:
            text = "é" * 90 + f" {i}" + "y" * 300 + "\nthe end is always the same"
            text = text if unit == "characters" else text.encode().decode()
        text = text[:limit] if unit == "characters" else text.encode()[:limit].decode("utf-8", "ignore")
        data.append((i, " M " if i % 2 else "m", text, 0))
    return data + [(1000 + i, "other", "y" * rnd.randint(20, 400) + ".", 0) for i in range(300)]


@pytest.mark.parametrize("unit", ["characters", "bytes"])
def test_spikes(spark, unit):
    df = frame(spark, limited(unit))
    spikes = {(r.source_key, r.unit, r.length) for r in C.length_spikes(df, "model", "raw_thinking").collect()}
    assert ("m", unit, 200) in spikes and not {s for s in spikes if s[0] == "other"}
    judged = {(r[0], r[1]): r[2] for r in C.cut_values(df, ENTRIES).groupBy("source_key", "evidence").agg(F.count("*")).collect()}
    assert judged["m", "limit"] > 200 and set(judged) >= {("m", "limit"), ("m", None), ("other", None)} and ("other", "limit") not in judged
    report = {r.source_key: r for r in C.cut_report(df, ENTRIES).collect()}
    assert f"200 {unit}" in report["m"].limits and report["other"].limits is None
    assert report["m"].n_values == 600 and report["m"].n_cut_by_limit == judged["m", "limit"]


def test_the_spikes_decide(spark, monkeypatch):
    """Without them, edges cut inside a free right side count as whole, and what a limit cuts alike as a manner of closing."""
    def at(i):
        end = "\nFINAL: A -> some effect typed fr" if i % 2 else "\nthe end is always the sam"
        return f"{i:04d} " + "x" * (300 - 5 - len(end)) + end

    data = [(i, "m", at(i), 0) for i in range(100)] + [(500 + i, "m", "w" * (20 + i % 250) + ".", 0) for i in range(1000)]
    df = frame(spark, data)
    found = lambda: {r.row_id for r in C.cut_values(df, ENTRIES).where("evidence IS NOT NULL").collect()}
    assert found() == set(range(100))
    monkeypatch.setattr(C, "SPIKE_LEAST", 10**9)
    assert found() == set()


def test_long_last_lines_are_read_whole(spark):
    long = "word " * 100_000
    got = {r.row_id: r.evidence for r in C.cut_values(frame(spark, [(1, "a", long + "ends.", 0), (2, "b", long + "end", 0)])).collect()}
    assert got == {1: None, 2: "context"}


def test_empty(spark):
    df = frame(spark, [])
    assert C.cut_values(df).count() == 0 and C.cut_report(df).count() == 0
    got = rows(C.cut_values(frame(spark, [(1, None, "x - -> ", 0), (1, None, "x - -> ", 0)])).select("row_id", "source_key", "evidence"))
    assert got == [(1, "", "context")] * 2
