import random
import re

import pytest

from siltstone.llm import license_scan as L


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_base_phrases(odd, texts):
    got = sorted(((r.doc_id, r.n_words, [(x.label, x.first) for x in r.phrases]) for r in L.scan(odd).collect()), key=str)
    want = []
    for i, t in texts:
        w, found = words(t), []
        for p, label in L.PHRASES.items():
            p = p.split()
            found += [(label, k) for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
        want.append((i, len(w), sorted(found, key=lambda f: f[1])))
    assert got == sorted(want, key=str)


def test_empty_table(none):
    assert L.scan(none).count() == 0


def pattern(markup):
    """A template as a regular expression over words that end in a space."""
    out, at = "", 0
    for m in re.finditer(r"<<(beginOptional|endOptional|var)(?:;max=(\d+))?>>|([^\s<>]+)", markup):
        out += re.escape(m[3]) + " " if m[3] else "(?:" if m[1] == "beginOptional" else ")?" if m[1] == "endOptional" else r"(?:\S+ ){0,%s}" % (m[2] or 1)
    return out


MARKUPS = ["a b", "a <<beginOptional>>x y<<endOptional>> b c", "<<beginOptional>>q<<endOptional>> a <<var;max=3>> c", "a <<beginOptional>>b <<var;max=2>><<beginOptional>>c<<endOptional>> d<<endOptional>> e"]


@pytest.mark.parametrize("markup", MARKUPS)
def test_automaton_equals_a_regular_expression(markup):
    rng = random.Random(markup)
    template = L.Template("t", markup)
    for _ in range(1500):
        w = [rng.choice("abcdexyq") for _ in range(rng.randint(0, 9))]
        whole = [k for k in range(len(w) + 1) if re.fullmatch(pattern(markup), "".join(x + " " for x in w[:k]))]
        assert template.match([x.encode() for x in w], 0) == (max(whole) if whole else None), w


def test_templates():
    for label, markup in L.TEMPLATES.items():
        plain = re.sub(r"<<var;max=\d+>>", "some name", re.sub(r"<<(begin|end)Optional>>", "", markup))
        plain = re.sub(r"http https", "https", plain)
        plain = re.sub(r"some name(?= of the license or)", "3", plain)
        text = "before it " + plain.upper().replace(" ", ", ") + " after"
        if label == "gpl-header":
            text = text.replace("SOME, NAME", "3")
        t = L.Template(label, markup)
        w = L.words_of(text)
        assert t.spans(b" " + b" ".join(w) + b" ", w), label


def test_wording_must_be_exact():
    t = L.Template("isc", L.TEMPLATES["isc-text"])
    w = L.words_of(L.TEMPLATES["isc-text"].replace("hereby", "not").replace("<<beginOptional>>", "").replace("<<endOptional>>", "").replace("<<var;max=8>>", "me"))
    assert not t.spans(b" " + b" ".join(w) + b" ", w)


@pytest.mark.parametrize("label, last", [("mit-text", "dealings in the software"), ("bsd-text", "of such damage"), ("isc-text", "performance of this software"), ("gpl-header", "along with this program")])
def test_the_whole_wording_is_mandatory(label, last):
    t = L.Template(label, L.TEMPLATES[label])
    plain = re.sub(r"<<beginOptional>>if not see.*", "", L.TEMPLATES[label])
    plain = re.sub(r"<<(begin|end)Optional>>", "", re.sub(r"<<var;max=\d+>>", "3", plain)).strip()
    assert plain.endswith(last)
    for text, held in ((plain, True), (plain[: -len(last)], False), (plain.replace("warranty of", "x").replace("fitness for a particular", "x").replace("consequential", "x").replace("without limitation", "x"), False)):
        w = L.words_of(text)
        assert bool(t.spans(b" " + b" ".join(w) + b" ", w)) == held


def test_linear_in_repeated_anchors():
    import time

    for label, markup in L.TEMPLATES.items():
        t = L.Template(label, markup)
        w = t.anchor.split() * (5_000_000 // len(t.anchor))
        joined = b" " + b" ".join(w) + b" "
        began = time.process_time()
        t.spans(joined, w)
        L.places(joined, t.anchor)
        assert time.process_time() - began < 30, label


def test_notices(spark):
    rows = [(1, "Released under the MIT License."), (2, "Licensed under the Apache License, Version 2.0."), (3, "This work is licensed under the GNU General Public License, version 3."), (4, "Licensed under CC BY-NC 4.0."), (5, "no licence at all"), (6, "the mit license mit license")]
    got = {r.doc_id: (sorted({m.label for m in r.matches}), r.score) for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i][0] for i in range(1, 7)] == [["mit-notice"], ["apache-2.0-notice"], ["gpl-3.0-notice"], ["cc-by-nc-4.0-notice"], [], []]
    assert got[1][1] == 1.0 and got[5][1] == 0.0 and got[6][1] == pytest.approx(4 / 5)


@pytest.mark.parametrize("markup", ["a <<beginOptional>> b", "a <<endOptional>>", "<<var;max=3>>"])
def test_bad_markup(markup):
    with pytest.raises(ValueError):
        L.Template("x", markup)
