import random
import re

import pytest

from kinweave.llm import licenses
from kinweave.llm.licenses import PHRASES, TEXTS, scan, scan_licenses


def brute(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    return len(words), sorted((i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())


ODD = ["", None, "Under The MIT License under the mit license", "apache-license, version 2.0 CC BY-NC CC_BY_NC", "xunder the mit license", "É under the mit licenseé", "under the mit", "cc by nc", "apache license version 2"]


def test_phrases(texts):
    for text in [*ODD, *texts]:
        n, base, _ = scan(text)
        assert (n, base) == brute(text)


def test_templates():
    def labels(text):
        return {(x[2], x[3]) for x in scan(text)[2]}

    assert ("gpl", "notice") in labels("This work is licensed under the GNU General Public License, version 3.")
    assert ("cc-by-nc", "notice") in labels("Licensed under CC BY-NC 4.0.")
    mit = TEXTS["mit"][0].replace("<<optional>> including the next paragraph <<end>>", "").replace("<<any:8>>", "the authors or copyright holders")
    assert ("mit", "text") in labels("Copyright\n" + mit.upper() + " x")
    assert ("mit", "text") in labels(mit.replace("permission notice", "permission notice (including the next paragraph)", 2).replace("(including the next paragraph) appear", "appear"))
    assert ("mit", "text") not in labels(mit.replace("without limitation", "with limitation"))
    assert ("mit", "text") not in labels(mit[:-10])


@pytest.mark.parametrize("rows", [[], [(1, ODD[2], "q"), (1, ODD[2], "q"), (None, None, None)]])
def test_rows(spark, rows):
    got = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, found string")).collect()
    assert sorted((r.doc_id or 0, r.n_words, len(r.base), r.score) for r in got) == sorted((r[0] or 0, *((8, 2, 0.6) if r[1] else (0, 0, 0.0))) for r in rows)


def test_automaton_against_regular_expressions():
    """Random templates over few words: the longest end among all that a regular expression accepts."""
    rng = random.Random(8)
    for _ in range(300):
        markup, shape, opened = ["a"], ["a "], False
        for _ in range(rng.randrange(1, 7)):
            kind = rng.randrange(5)
            if kind == 0 and not opened:
                markup.append("<<optional>>")
                shape.append("(?:")
                opened = True
                kind = 4
            elif kind == 1:
                n = rng.randrange(1, 3)
                markup.append(f"<<any:{n}>>")
                shape.append(f"(?:[a-c] ){{0,{n}}}")
                continue
            word = rng.choice("abc")
            markup.append(word)
            shape.append(f"{word} ")
            if opened and rng.random() < 0.5:
                markup.append("<<end>>")
                shape.append(")?")
                opened = False
        if opened:
            markup.append("<<end>>")
            shape.append(")?")
        t, words = licenses.Template("x", "text", " ".join(markup)), [rng.choice("abc") for _ in range(12)]
        for at in range(len(words)):
            ends = [e for e in range(at, len(words) + 1) if re.fullmatch("".join(shape), "".join(f"{w} " for w in words[at:e]))]
            assert t.accepts([w.encode() for w in words], at) == max(ends, default=None), (markup, words, at)


def test_each_template_takes_its_own_wording(spark):
    """Without the optional parts, and with them and one word for each gap."""
    for t in licenses.templates():
        for markup in [m for group in (licenses.NOTICES, licenses.TEXTS) for m in group.get(t.label, []) if licenses.Template("x", "y", m).words == t.words]:
            bare = re.sub(r"<<optional>>.*?<<end>>|<<any:[0-9]+>>", " ", markup)
            full = re.sub(r"<<any:[0-9]+>>", " some ", re.sub(r"<<optional>>|<<end>>", " ", markup))
            for text in (bare, full.upper()):
                assert (t.label, t.kind) in {f[2:] for f in licenses.scan(f"x {text} y")[2]}, (t.label, text)
            words = bare.split()
            at = words.index(t.anchor[0])
            if t.kind == "text":  # a word within the mandatory wording, and one that lacks at its end
                assert t.accepts([w.encode() for w in [*words[: at + 2], "zzz", *words[at + 2 :]]], at) is None, t.label
                last = bare.rstrip().split() if not markup.endswith("<<end>>") else words
                assert t.accepts([w.encode() for w in last[:-1]], at) is None, t.label
