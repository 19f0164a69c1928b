"""Languages of many letters, and many languages."""

import random

import numpy as np

from hanmoa.llm import crossparse


def test_every_letter_of_a_sample_is_told_apart():
    r = random.Random(1)
    letters = [chr(0x4E00 + i) for i in range(1200)]
    words = ["".join(r.sample(letters, 3)) for _ in range(900)]
    made = crossparse.build({"zz": [" ".join(words[:600])], "aa": [" ".join(words[600:])], "mm": ["\U00020000\U00020001\U00020002 " * 3]})
    assert made.predict([" ".join(words[300 + i : 304 + i]) for i in range(0, 280, 10)])[0] == ["zz"] * 28
    names, score = made.predict(["\U00020000\U00020001", "\U0001F600 12", "\U0002A000", None])
    assert names == ["mm", "und", "mm", "und"] and score[0] > 0.5 and score[1] == 0 and score[2] > 0


def test_steps_equal_the_automaton():
    r = random.Random(2)
    line = [r.randrange(2, 9) for _ in range(400)]
    auto = crossparse.SuffixAutomaton(line)
    table = crossparse.StepTable(auto.steps(), 10)
    state, symbol = (a.ravel() for a in np.meshgrid(np.arange(len(auto.next)), np.arange(10), indexing="ij"))
    to, hit = table.find(state, symbol)
    assert [t if h else None for t, h in zip(to.tolist(), hit.tolist(), strict=True)] == [auto.next[s].get(c) for s, c in zip(state.tolist(), symbol.tolist(), strict=True)]


def test_many_languages_keep_their_samples():
    words = {f"l{k:02}": ["".join(random.Random(k * 1000 + i).choices("abcdefghijklmnopqrstuvwxyz", k=6)) for i in range(60)] for k in range(30)}
    samples = {k: [" ".join(random.Random(i).choices(w, k=40)) for i in range(110)] for k, w in words.items()}
    made = crossparse.build(samples)
    assert made.bits.tolist() == [np.log2(crossparse.SAMPLE_CHARS)] * 30


def test_sample_is_not_the_first_rows_by_text():
    r = random.Random(3)
    first, rest = (["".join(r.choices("bcdfgh", k=6)) for _ in range(40)] for _ in range(2))
    samples = {"a": ["0 " + " ".join(r.choices(first, k=200)) for _ in range(60)] + ["z " + " ".join(r.choices(rest, k=200)) for _ in range(60)], "b": [" ".join(rest[:3])]}
    assert crossparse.build(samples).predict([" ".join(rest[5:20])])[0] == ["a"] and crossparse.build(samples).phrases([crossparse.symbols_of(" ".join(rest), crossparse.build(samples).symbol)])[0][0, 0] < 80
