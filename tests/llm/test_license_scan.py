import pytest

from tidemark.llm.license_scan import TEMPLATES, Scanner, known_licenses, scan_licenses, short_forms

FILLER = "Some other prose that is not about terms at all, and goes on for a while. "


@pytest.fixture(scope="module")
def scanner():
    return Scanner(TEMPLATES)


@pytest.mark.parametrize("name, text", [(name, t) for name, texts in TEMPLATES.items() for t in texts])
def test_templates_in_prose(scanner, name, text):
    body = FILLER * 3 + text + " " + FILLER * 3
    (found,) = scanner.scan(body)
    assert found["license"] == name and found["differences"] == []
    assert body[found["start"] : found["end"]].strip(".") in text


def test_wording(scanner):
    text = "# This program is free software: you may redistribute it and/or modify it\n# under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version."
    (found,) = scanner.scan(text)
    assert (found["license"], found["differences"]) == ("GPL-3.0", ["can > may"])


@pytest.mark.parametrize(
    "text",
    ["", "Licensed under the Apache License, Version 1.1.", "Released under the BIT License.", "a license to print money", FILLER,
     "Licensed under CC BY-ND 4.0.", "This work is licensed under the GNU General Public License, version 1."],
)
def test_others(scanner, text):
    assert scanner.scan(text) == []


@pytest.fixture(scope="module")
def full_scanner():
    return Scanner(known_licenses())


@pytest.mark.parametrize(
    "text, names",
    [("// SPDX-License-Identifier: Apache-2.0", ["Apache-2.0"]), ("SPDX-License-Identifier: GPL-2.0-or-later", ["GPL-2.0"]),
     ("Licensed under the MIT License.", ["MIT"]), ("licensed under the terms of the MIT license", ["MIT"]),
     ("Licensed under the Apache License 2.0", ["Apache-2.0"]), ("free to use under the GNU GPL v3", ["GPL-3.0"]),
     ("Licensed under GPLv3, see the file", ["GPL-3.0"]), ("Released under the 2-Clause BSD License", ["BSD-2-Clause"]),
     ("Mozilla Public License 2.0", ["MPL-2.0"]), ("GNU Lesser General Public License, version 2.1", ["LGPL-2.1"]),
     ("SPDX-License-Identifier: GPL-1.0", []), ("Mozilla Public License 1.1", []), ("the MIT license is short", []), ("GPL", []),
     ("under the BSD 4-Clause License", [])],
)
def test_short_forms(full_scanner, text, names):
    for around in ("", FILLER * 3):
        assert [f["license"] for f in full_scanner.scan(f"{around}{text} {around}")] == names


def test_every_form_in_prose(full_scanner):
    for name, texts in known_licenses().items():
        for text in texts:
            assert [f["license"] for f in full_scanner.scan(FILLER * 2 + text + ". " + FILLER)] == [name], text


def test_forms_name_one_license():
    words = [tuple(t.lower().replace(",", "").split()) for texts in short_forms().values() for t in texts]
    assert len(set(words)) == len(words)


def test_a_template_without_a_cue(table):
    with pytest.raises(ValueError, match="no cue"):
        scan_licenses(table((1, "x")), "doc_id", "text", {"Own": ["use it as you like"]})


def test_several_in_a_long_text(scanner):
    text = FILLER * 400 + "Released under the MIT License. " + "Licensed under CC BY-NC 4.0. " + FILLER * 400 + "Released under the MIT License."
    assert [f["license"] for f in scanner.scan(text)] == ["MIT", "CC-BY-NC-4.0", "MIT"]


@pytest.mark.parametrize("size", [600, 5_000, 20_000])
def test_many_cues(scanner, size):
    """Notices are found however long a text is and however many cues it has."""
    prose = [f"{a}{b}" for a in FILLER.replace(".", "").lower().split() for b in ("", "s", "ed", "ing", "er")]
    words = [prose[i * i % len(prose)] if i % 50 else "license" for i in range(size)]
    texts = [t for name in ("MIT", "GPL-3.0", "Apache-2.0", "CC-BY-4.0") for t in TEMPLATES[name]]
    for i, notice in enumerate(reversed(texts)):
        words[(len(texts) - i) * size // (len(texts) + 1)] = notice
    found = scanner.scan(" ".join(words))
    assert [f["license"] for f in found] == ["MIT"] * 2 + ["GPL-3.0"] * 2 + ["Apache-2.0"] * 2 + ["CC-BY-4.0"] * 2
    assert all(f["differences"] == [] for f in found)


def test_a_notice_at_the_edge_of_a_window(scanner):
    """The long form stands, though the window of the first cue has only the short one that it begins with."""
    for gap in range(0, 80, 4):
        for name in ("Apache-2.0", "MIT"):
            text = "a license of" + " and" * gap + " " + TEMPLATES[name][1]
            (found,) = scanner.scan(text)
            assert text[found["start"] : found["end"]] == TEMPLATES[name][1] and found["differences"] == []


def test_ranks(scanner):
    ranked = scanner.ranked("released under the mit license".split())
    assert ranked[0][1].name == "MIT"
    assert [n for n, _ in ranked] == sorted((n for n, _ in ranked), reverse=True)


def test_tables(awkward, table):
    rows = scan_licenses(awkward, "doc_id", "text").collect()
    assert len(rows) == awkward.count() and all(r.licenses == [] for r in rows)
    (row,) = scan_licenses(table((1, "x\nLicensed under the Apache License, Version 2.0.\ny")), "doc_id", "text").collect()
    assert [(f.license, f.start, f.end) for f in row.licenses] == [("Apache-2.0", 2, 48)]
    assert scan_licenses(awkward.where("false"), "doc_id", "text").count() == 0
    (row,) = scan_licenses(table((1, "use of the beer ware licence")), "doc_id", "text", {"Beer": ["the beer ware licence"]}).collect()
    assert [f.license for f in row.licenses] == ["Beer"]
