"""Lines of many texts, cut at once, against plain loops."""

import random

import numpy as np
import xxhash

from corpusloom.llm import line_dedup


def test_lines_of_many_texts_are_cut_at_once(monkeypatch):
    calls, unique = [], np.unique
    monkeypatch.setattr(line_dedup.np, "unique", lambda *a, **k: calls.append(1) or unique(*a, **k))
    rng = random.Random(5)
    parts = ["a", "bc", "é", "漢", "\U0001f600", "​", "\n", " ", *filter(str.isspace, map(chr, range(0x10000)))]
    texts = ["", "\n", "a", "a　", " a", "a\xa0\n　b", *("".join(rng.choices(parts, k=rng.randrange(40))) for _ in range(500))]
    for least in (1, 4):
        calls.clear()
        numbers = np.arange(len(texts))
        rows = line_dedup.places_of(numbers, -numbers, [x.encode() for x in texts], least).to_pylist()
        assert len(calls) == 1
        wanted = []
        for d, text in enumerate(texts):
            lines, own = text.split("\n"), set()
            words = [len(x.split()) for x in lines]
            for p in range(len(lines)):
                own |= set([(p, n) for n in range(1, len(lines) - p + 1) if sum(words[p : p + n]) >= least][:1])
            # Runs up to a line, which may hold no words itself, begin as late as they can.
            for p in range(len(lines)):
                begins = [a for a in range(p + 1) if sum(words[a : p + 1]) >= least]
                own |= {(begins[-1], p + 1 - begins[-1])} if begins else set()
            wanted += [(d, -d, p, lines[p], sorted(n for a, n in own if a == p)) for p in range(len(lines))] if own else []
        assert [(r["d"], r["t"], r["pos"], r["depths"]) for r in rows] == [(d, t, p, n) for d, t, p, _, n in wanted]
        assert [(r["h1"], r["h2"]) for r in rows] == [tuple(np.frombuffer(xxhash.xxh3_128_digest(line.encode()), ">i8").tolist()) for *_, line, _ in wanted]
