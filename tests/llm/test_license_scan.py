"""License notices: right names, edits, broken lines, long texts; recall against exhaustive alignment."""

import random

import pytest

from talkloom.llm import license_scan as ls

FILLER = [f"{a}{b}{c}" for a in "bdkmp" for b in "aeiou" for c in ("n", "rt", "lm", "s")]


def found(text):
    return [(name, missing, extra) for _, _, name, _, missing, extra in ls.notices([ls.word(m.group()) for m in ls._WORDS.finditer(text)], 0.3, 0.15)] if ls.may_hold(text) else []


def test_every_wording_is_found_under_its_name():
    for name, texts in ({k: [v] for k, v in ls.TEMPLATES.items()} | ls.references()).items():
        for text in texts:
            assert len(list(ls.GATE.finditer(text))) >= 2
        for text in texts[:: max(1, len(texts) // 12)]:
            assert found(f"kart {text} pan") == [(name, [], [])], text


@pytest.mark.parametrize(
    ("text", "name"),
    [
        ("This work is licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0-line"),
        ("This work is licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0-line"),
        ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0-line"),
        (ls.TEMPLATES["GPL-3.0"].replace("version 3", "version 2"), "GPL-2.0"),
        (ls.TEMPLATES["GPL-3.0"].replace("General", "Lesser General"), "LGPL-3.0"),
        (ls.TEMPLATES["MPL-2.0"].replace("2.0", "1.1"), None),
        ("Licensed under the Apache License, Version 1.1.", None),
        ("This work is licensed under a Creative Commons Attribution-\nShareAlike 4.0 International License.", "CC-BY-SA-4.0-line"),
        ("This work is licensed under a Creative Commons Attribution-\n  # NonCommercial-\n  # NoDerivatives 4.0 International License.", "CC-BY-NC-ND-4.0-line"),
        ("Licensed under the MIT license.", "MIT-line"),
        ("// SPDX-License-Identifier: Apache-2.0", "Apache-2.0-line"),
        ("Distributed under the terms of the GNU GPL v3.", "GPL-3.0-line"),
        ("This work is licensed under CC-BY-4.0", "CC-BY-4.0-line"),
        (ls.TEMPLATES["0BSD"], "0BSD"),
        (ls.TEMPLATES["CC0-1.0-line"].replace("copyright", "intellectual"), "CC0-1.0-line"),
        ("the driving license of the MIT student is under review", None),
    ],
)
def test_names(text, name):
    assert [n for n, *_ in found(f"mert {text} dan")] == ([name] if name else [])


def distance(template, words):
    """The least number of differences of a template's words anywhere in the words, larger of missing and put in."""
    above = [(0, 0, 0)] * (len(words) + 1)
    for i, w in enumerate(template, 1):
        row = [(i, i, 0)]
        for j, v in enumerate(words, 1):
            a, b, c = above[j - 1], above[j], row[-1]
            row.append(min((a[0] + (w != v), a[1] + (w != v), a[2] + (w != v)), (b[0] + 1, b[1] + 1, b[2]), (c[0] + 1, c[1], c[2] + 1)))
        above = row
    return min(max(m, e) for _, m, e in above)


def test_recall_against_exhaustive_alignment():
    """Notices with edits in other text: what an alignment of every license with the whole text finds is found, and nothing else is planted."""
    rng = random.Random(11)
    planted = caught = 0
    for _ in range(120):
        name = rng.choice(list(ls.TEMPLATES))
        words = ls.TEMPLATES[name].split(" ")
        free = [i for i, w in enumerate(words) if not any(map(ls.tells, ls.wording(w)))]
        for i in rng.sample(free, min(len(free), rng.randrange(0, max(1, int(0.2 * len(words)))))):
            words[i] = rng.choice(["", rng.choice(FILLER), f"{words[i]} {rng.choice(FILLER)}"])
        text = " ".join(rng.choices(FILLER, k=rng.randrange(0, 60)) + words + rng.choices(FILLER, k=rng.randrange(0, 60)))
        want = min(distance(w, ls.wording(text)) - 0.15 * len(w) for w in ls._licenses()[0][name]) <= 0
        got = [n for n, *_ in found(text)]
        if want:
            planted += 1
            caught += name in got
        assert set(got) <= {name, *({"MIT", "MIT-text"} if name in ("MIT", "MIT-text") else ()), *(("BSD", "BSD-2-Clause") if name.startswith("BSD") else ()), *(("Apache-2.0-line",) if name == "Apache-2.0" else ()), *(("BSL-1.0-line",) if name == "BSL-1.0" else ()), *(("ISC", "0BSD") if name in ("ISC", "0BSD") else ())}, (name, got)
    assert planted > 50 and caught >= 0.9 * planted


def test_blocks_are_bounded_and_lose_nothing():
    """A text of license words throughout: blocks stay small, and notices are found wherever blocks meet."""
    rng = random.Random(3)
    mit, apache = ls.wording(ls.TEMPLATES["MIT"]), ls.wording(ls.TEMPLATES["Apache-2.0-line"])
    noise = sorted({*mit, *ls.wording(ls.TEMPLATES["Apache-2.0"])})
    words, at = [], []
    for k in range(60):
        words += rng.choices(noise, k=rng.randrange(0, 900))
        at.append((len(words), len(words) + len(mit if k % 2 else apache)))
        words += mit if k % 2 else apache
    import numpy as np

    number = ls._licenses()[1]
    windows = ls._windows(np.array([number[w] for w in words]), set(words), 0.15)
    longest = max(len(n) for all_ in windows.values() for _, n, _ in all_)
    of = list(ls.blocks(windows, ls.BLOCK))
    assert max(e - b for b, e, _ in of) <= ls.BLOCK + 4 * longest and len(of) > 5
    got = {(s, e): n for s, e, n, *_ in ls.notices(words, 0.3, 0.15)}
    assert all(p in got for p in at) and {got[p] for p in at} == {"MIT", "Apache-2.0-line"}


def test_scan(spark):
    """Nulls, repeated rows, ties, clashing names, lines, a very long text, no rows; ids that are no numbers raise."""
    line = "Licensed under the Apache License, Version 2.0."
    long = "\n".join(" ".join(FILLER[:30]) for _ in range(20_000)) + f"\n{line}\n" + "license under copyright " * 50_000
    rows = [(1, f"a\n\n{line} {line}\nb"), (1, f"a\n\n{line} {line}\nb"), (None, line), (2, None), (3, ""), (4, long), (5, "x " + ls.TEMPLATES["ISC"].replace(" ", "\n"))]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, license string, id int").repartition(3)
    got = sorted(((r.doc_id, r.license, r.first_line, r.last_line, r.n_differences) for r in ls.scan(df).collect()), key=str)
    twice = [(1, "Apache-2.0-line", 2, 2, 0)] * 4
    assert got == sorted([*twice, (None, "Apache-2.0-line", 0, 0, 0), (4, "Apache-2.0-line", 20_000, 20_000, 0), (5, "ISC", 0, len(ls.TEMPLATES["ISC"].split()) - 1, 0)], key=str)
    assert ls.scan(df.where("false")).count() == 0
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        ls.scan(spark.createDataFrame([("x", line)], "doc_id string, text string")).collect()
