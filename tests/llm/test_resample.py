"""Importance resampling against a plain computation, and its odd rows."""

import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from deskbook.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def expected(docs, target, percent=25, least=20):
    bucket = lambda f: crc32(f.encode()) % 10000
    raw, aim = (Counter(bucket(f) for t in texts for f in features(t)[1]) for texts in ([t for _, t in docs], target))
    s, t = sum(raw.values()), sum(aim.values())
    gain = lambda b: math.floor(1000 * math.log((aim[b] + 1) * (s + 10000) / ((raw[b] + 1) * (t + 10000))))
    rows = []
    for doc, text in docs:
        words, own = features(text)
        weight = sum(gain(bucket(f)) for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([doc, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= least])
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0], r[1]))
    ranks = [(*r[:4], i if i <= len(able) * percent // 100 else None) for i, r in enumerate(able, 1)]
    return sorted(ranks + [(*r[:4], None) for r in rows if not r[4]], key=str)


def test_against_a_plain_computation(spark):
    rng = np.random.default_rng(3)
    words = ["der", "Haus", "été", "x1", "Blau", "die", "und", "ño", "42", "\U0001f600"]
    say = lambda n: " ".join(rng.choice(words, n)) + "!\n"
    docs = [(i, say(int(rng.integers(0, 60)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, " .,;\x00"), (7, say(30)), (7, docs[7][1]), (None, say(25)), ((1 << 53) + 1, say(50_000)), (104, "q" * 300_000 + " " + say(22)), (105, say(19).replace(" ", "-"))]
    docs += [(500, docs[3][1] + say(20))] * 4  # repeated rows
    target = [say(13) for _ in range(5)] + [None, "", "der die der"]
    frame = lambda rows: spark.createDataFrame([(i, t, 1, 1) for i, t in rows], "doc_id long, text string, score int, rank int")
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = sorted((tuple(r) for r in resample.resample(frame(docs).repartition(5), aim).collect()), key=str)
    assert got == expected(docs, target)
    assert resample.resample(frame([]), aim).collect() == []
    assert sorted((tuple(r) for r in resample.resample(frame(docs[:40]), aim.limit(0), percent=60, least_words=5).collect()), key=str) == expected(docs[:40], [], 60, 5)


def test_pieces_of_a_text_give_the_features_of_the_whole():
    text = "One two, three  Four five\x00 ünf six seven" * 30
    whole = np.sort(np.concatenate([b for _, b in resample.bucket_runs(text)]))
    assert len(whole) == len(features(text)[1])
    for piece in (1, 2, 7, 40):
        runs = list(resample.bucket_runs(text, piece=piece))
        assert np.array_equal(np.sort(np.concatenate([b for _, b in runs])), whole) and sum(n for n, _ in runs) == len(features(text)[0])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-40_000, 40_000), min_size=1, max_size=200), st.data())
def test_sliced_sums_are_exact(gain, data):
    counts = np.array(data.draw(st.lists(st.integers(0, 1 << 40), min_size=len(gain), max_size=len(gain))), np.int64)
    assert resample.SlicedGains(np.array(gain, np.int64)).total(counts) == sum(int(c) * g for c, g in zip(counts, gain))
