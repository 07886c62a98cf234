"""License spans against a plain version: votes near one diagonal, chained by dynamic programming."""

import random
import re

from gridloom.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(text):
    """(labels, score) of a text."""
    w = words_of(text)
    labels, score = set(), 0.0
    for label, phrase in licenses.PHRASES.items():
        p = phrase.split(" ")
        if any(w[i : i + len(p)] == p for i in range(len(w))):
            labels.add(label)
            score = 1.0
    for label, texts in licenses.TEMPLATES.items():
        for template in texts:
            t = template.split(" ")
            votes = [(i, j) for i in range(len(w) - 1) for j in range(len(t) - 1) if w[i : i + 2] == t[j : j + 2]]
            for d in {i - j for i, j in votes}:
                near = sorted(v for v in votes if d <= v[0] - v[1] <= d + licenses.SPREAD)
                best = {}
                for v in near:
                    best[v] = 1 + max((n for u, n in best.items() if u[0] < v[0] and u[1] < v[1]), default=0)
                share = max(best.values()) / (len(t) - 1)
                score = max(score, share)
                if share >= 0.8:
                    labels.add(label)
    return ",".join(sorted(labels)), score


def test_spans_are_those_of_the_plain_version(spark):
    rng = random.Random(1)
    apache = licenses.TEMPLATES["apache"][0].split(" ")
    every = [t.split(" ") for texts in licenses.TEMPLATES.values() for t in texts]
    diluted = "licensed " + " ".join(f"{a} x{k} z{k} {a}" for k, a in enumerate(apache[1:-1], 1)) + " 0"
    pairs_apart = " ".join(f"{a} {b} x{k} z{k}" for k, (a, b) in enumerate(zip(apache, apache[1:], strict=False)))
    texts = [None, "", diluted, pairs_apart, pairs_apart + " " + " ".join(apache), " ".join(" ".join(p) for p in reversed(list(zip(apache, apache[1:], strict=False)))), "worK this worK is licensed under the GNU General Public License version 3", "released under the mit license".replace("k", "\u212a") + " use this file except in compliance with the wor\u212a"]
    for t in every:
        for _ in range(4):
            w = list(t)
            for _ in range(rng.randrange(7)):
                i, what = rng.randrange(len(w)), rng.random()
                if what < 0.35:
                    w.insert(i, rng.choice(["and", "the", "x", t[0]]))
                elif what < 0.7 and len(w) > 3:
                    w.pop(i)
                else:
                    j = rng.randrange(len(w))
                    w[i], w[j] = w[j], w[i]
            texts.append("Some text. " + " ".join(w).upper() + " and the rest " + " ".join(rng.choice(every)[:5]))
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.labels, round(r.score, 9)) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {i: (labels, round(score, 9)) for i, (labels, score) in ((i, plain(t)) for i, t in rows)}
    assert got == want
    assert got[2][0] == got[3][0] == got[5][0] == "" and got[4] == ("apache", 1.0)
    assert got[6][0] == "gpl,gpl-notice"


def test_pieces_change_nothing(spark, odd):
    """Texts cut after every few characters: the same words, places and labels; whatever stands at a cut."""
    rng = random.Random(2)
    every = [t for texts in licenses.TEMPLATES.values() for t in texts]
    rows = [(k, "".join(rng.choice([" ", "-", "  ", "é", "cc", "by", "All rights Reserved.", rng.choice(every)]) + rng.choice(["", " "]) for _ in range(rng.randrange(30)))) for k in range(60)]
    rows += [(100, "---"), (101, "   cc by   "), (102, "x" * 50 + "  "), (103, "cc" + " " * 40 + "by")]
    mine = spark.createDataFrame(rows, "doc_id long, text string")
    for docs in (mine, odd.select("doc_id", "text")):
        want = sorted(map(str, licenses.scan(docs).collect()))
        for piece in (1, 7, 40):
            assert sorted(map(str, licenses.scan(docs, piece=piece).collect())) == want
