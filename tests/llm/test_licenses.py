"""License scan against containment in all windows, computed directly."""

import random

import pytest

from tessella.llm.decontam import words
from tessella.llm.license_scan import TEMPLATES, scan_licenses


def brute(text, templates, least=0.8):
    """(name, place, containment) of the windows of each template's length that hold enough of its shingles, and the names that some longer window holds."""
    w = words((text or "").encode())
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    sure, possible = [], set()
    for name, t in templates.items():
        tw = words(t.encode())
        want = {tuple(tw[i : i + 5]) for i in range(len(tw) - 4)}
        share = lambda i, size: len(want & set(grams[i : i + size - 4])) / len(want)
        sure += [(name, i, share(i, len(tw))) for i in range(len(grams)) if share(i, len(tw)) >= least]
        if any(share(i, len(tw) + max(1, len(tw) // 4)) >= least for i in range(len(grams))):
            possible.add(name)
    return sure, possible


def test_against_all_windows(spark):
    rng = random.Random(6)
    say = lambda n: [rng.choice("the of licensed under license mit version 2 x y z".split()) for _ in range(n)]
    docs = []
    for i in range(150):
        w = say(rng.randint(0, 120))
        for _ in range(rng.randint(0, 3)):
            notice = rng.choice(list(TEMPLATES.values())).split()
            if rng.random() < 0.3 and len(notice) > 12:
                notice[rng.randrange(len(notice))] = "changed"
            at = rng.randint(0, len(w))
            w[at:at] = [x.upper() if rng.random() < 0.1 else x for x in notice]
        docs.append((i, rng.choice([" ", "\n"]).join(w)))
    docs += [(900, None), (901, ""), (902, "MIT License"), (903, "a b c " * 9000 + TEMPLATES["ISC"]), (None, TEMPLATES["MIT"]), (3, docs[3][1])]
    got = scan_licenses(spark.createDataFrame([(*d, "k") for d in docs], "doc_id long, text string, licenses string")).collect()
    assert len(got) == len(docs)
    as_table = spark.createDataFrame([*TEMPLATES.items(), ("none", None), ("none", ""), ("MIT", TEMPLATES["MIT"])], "name string, text string")
    in_parts = scan_licenses(spark.createDataFrame(docs, "doc_id long, text string"), as_table, part_bytes=700).collect()
    shown = lambda rows: sorted((str(r.doc_id), str(r.text), str(r.licenses)) for r in rows)
    assert shown(in_parts) == shown(got)
    for r in got:
        sure, possible = brute(r.text, TEMPLATES)
        assert {x.name for x in r.licenses} <= possible
        assert all(0 <= x.start < x.end <= len(words(r.text.encode())) and 0.8 <= x.containment <= 1 for x in r.licenses)
        assert all(x.end <= y.start for x, y in zip(r.licenses, r.licenses[1:], strict=False))
        for name, at, share in sure:  # each occurrence is found, or gave way to one that fits as well
            size = len(words(TEMPLATES[name].encode()))
            assert any(x.start < at + size and at < x.end and x.containment >= share - 1e-9 for x in r.licenses), (r.text, name, at, r.licenses)


@pytest.mark.parametrize(
    "text, names",
    [
        ("Released under the MIT License. " * 3, ["MIT"] * 3),
        ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]),
        (TEMPLATES["Apache-2.0-header"], ["Apache-2.0-header"]),
        (TEMPLATES["LGPL-3.0-header"] + " and " + TEMPLATES["GPL-2.0-header"] + TEMPLATES["AGPL-3.0-header"], ["LGPL-3.0-header", "GPL-2.0-header", "AGPL-3.0-header"]),
        ("x y z " + TEMPLATES["ISC"].replace("copy,", "copy, keep,") + " z", ["ISC"]),
    ],
)
def test_occurrences(spark, text, names):
    one = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [x.name for x in scan_licenses(one).first().licenses] == names


def test_limits(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert scan_licenses(df).count() == 0
    with pytest.raises(ValueError):
        scan_licenses(df, {"short": "too short"})
    many = {f"t{i}": f"{i} names of rule {i % 7} and {i + 1} more" for i in range(12_000)}
    found = scan_licenses(spark.createDataFrame([(1, "so " + many["t9000"] + " end")], "doc_id long, text string"), spark.createDataFrame(list(many.items()), "name string, text string"), part_bytes=100_000)
    assert [x.name for x in found.first().licenses] == ["t9000"]
    one = spark.createDataFrame([(1, "Released under the MIT License.")], "doc_id long, text string")
    assert scan_licenses(one, {}).first().licenses == []
