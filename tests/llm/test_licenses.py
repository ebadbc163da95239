import re
import textwrap

import pytest
from helpers import awkward, empty

from shopfloor.llm.license_templates import TEMPLATES
from shopfloor.llm.licenses import CUES, Scanner, differences, scan_licenses


def test_every_template_has_a_cue_and_finds_itself():
    s = Scanner()
    for name, text in TEMPLATES:
        assert re.search(CUES, text), text
        found = s.scan(f"Some words before it.\n{text}\nAnd after.")
        assert [f.license for f in found] == [name], text
        assert found[0].missing == 0


def test_versions_and_wording_decide():
    s = Scanner()
    assert [f.license for f in s.scan("This work is licensed under the GNU General Public License, version 2.")] == ["GPL-2.0"]
    assert s.scan("This work is licensed under the GNU General Public License, version 7.") == []
    assert s.scan("He renewed his fishing license and the copyright of the book was sold.") == []
    f = s.scan("Licensed under the famous Apache License, Version 2.0.")
    assert f[0].license == "Apache-2.0" and f[0].wording == "+famous"
    assert differences(["a", "b"], ["x", "a", "c", "b", "y"]) == ([], ["c"], "+c")


def test_several_and_very_long_texts():
    s = Scanner()
    two = "Released under the MIT License.\nnothing here\nLicensed under CC BY-NC 4.0.\n" + "filler words " * 50_000
    assert [f.license for f in s.scan(two)] == ["MIT", "CC-BY-NC-4.0"]
    many = "Released under the MIT License.\n" * 300
    assert {f.license for f in s.scan(many)} == {"MIT"}


def test_positions_and_awkward_rows(spark):
    df = awkward(spark, [(50, "日本 \U0001f600\nReleased under the MIT License.\nend"), (50, "Licensed under CC BY 4.0."),
                         (None, "Licensed under CC BY 4.0.")])
    got = scan_licenses(df).collect()
    assert sorted((str(r.doc_id), r.license) for r in got) == [("50", "CC-BY-4.0"), ("50", "MIT"), ("None", "CC-BY-4.0")]
    x = next(r for r in got if r.license == "MIT")
    assert "日本 \U0001f600\nReleased under the MIT License.\nend"[x.start:x.end] == "Released under the MIT License."
    assert scan_licenses(empty(spark)).collect() == []


@pytest.mark.parametrize("prefix", ["", "# ", " * ", "// ", "dnl "])
def test_wrapped_notices(prefix):
    s = Scanner()
    for name, text in TEMPLATES:
        for width in (32, 50, 72):
            notice = textwrap.fill(text, width, initial_indent=prefix, subsequent_indent=prefix, break_long_words=False)
            found = s.scan(f"int a = 1;\n{notice}\nint b = 2;")
            assert [(f.license, f.missing) for f in found] == [(name, 0)], notice


def test_nothing_is_read_across_numbers_and_sentences():
    s = Scanner()
    assert s.scan("This work is licensed under the GNU General Public License, version 7. Chapter 2 is here.") == []
    assert s.scan("The album was released under the label in 1999. The MIT students got a license.") == []


def test_neighbours_do_not_hide_a_notice():
    s = Scanner()
    for name, text in TEMPLATES:
        for near in ("Copyright (c) 2019-2024 Jane Roe and the toolkit contributors.", "All permissions are kept. " * 30):
            for doc in (f"{near}\n{text}", f"{text} {near}", f"{near} {text} {near}"):
                found = s.scan(doc)
                assert [(f.license, doc[f.start:f.end]) for f in found] == [(name, text)]


def test_every_notice_is_a_finding():
    s = Scanner()
    lists = [[0, 1], list(range(len(TEMPLATES))), list(range(len(TEMPLATES)))[::-1]]
    for sep in ("\n", " ", "\n\n"):
        for order in lists:
            assert [f.license for f in s.scan(sep.join(TEMPLATES[i][1] for i in order))] == [TEMPLATES[i][0] for i in order]
    assert [f.license for f in s.scan("Released under the MIT License.\nLicensed under the Apache License, Version 2.0.")] \
        == ["MIT", "Apache-2.0"]
    many = "Released under the MIT License.\n" * 300
    assert [many[f.start:f.end] for f in s.scan(many)] == ["Released under the MIT License."] * 300


OWN = (*TEMPLATES, ("House-1.0", "Anyone may reuse these recipes freely provided the kitchen is named and no warranty of taste is implied."),
       ("House-2.0", "Do whatever pleases you."))


def test_templates_without_a_cue_word_bring_their_own(spark):
    s = Scanner(OWN)
    for name, text in OWN[-2:]:
        assert [f.license for f in s.scan(f"Intro words.\n{text}\nEnd.")] == [name]
        assert [f.license for f in s.scan(textwrap.fill(text, 30, initial_indent="# ", subsequent_indent="# "))] == [name]
    lacking = OWN[-2][1].replace("recipes ", "")
    assert [(f.license, f.missing) for f in s.scan(f"x {lacking} y")] == [("House-1.0", 1)]
    df = spark.createDataFrame([(1, f"a {OWN[-1][1]} b"), (2, "nothing here")], "doc_id long, text string")
    assert [(r.doc_id, r.license) for r in scan_licenses(df, templates=OWN).collect()] == [(1, "House-2.0")]


def test_compression_ranks_the_right_template_first():
    """In a block with words around the notice, the template of the notice saves most, or one that contains it."""
    s = Scanner()
    for no, (name, text) in enumerate(TEMPLATES):
        ranked = s._ranked(f"We thank all who wrote to us. {text} The next part tells how to install it.")
        assert TEMPLATES[ranked[0]][0] == name or text in TEMPLATES[ranked[0]][1] or ranked.index(no) <= 2, text
        assert no in ranked


def test_planted_notices_recall():
    """Notices in comments, wrapped, with a word missing or added, between other words: all found, nothing else."""
    import random
    r, s = random.Random(7), Scanner()
    hits = 0
    for k in range(200):
        name, text = r.choice(TEMPLATES)
        words = text.split()
        if len(words) > 20 and k % 2:
            plain = [i for i, w in enumerate(words) if w.isalpha()]
            del words[r.choice(plain)]
        if k % 3 == 0:
            words.insert(r.randrange(2, len(words) - 1), "gladly")
        body = textwrap.fill(" ".join(words), r.choice([36, 60, 400]), initial_indent="// ", subsequent_indent="// ", break_long_words=False)
        hits += [f.license for f in s.scan(f"int a = {k};\n{body}\nreturn a;\n" + "some other words " * r.randrange(40))] == [name]
    assert hits >= 190
