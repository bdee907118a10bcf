"""License scans by conditional compression.

Around cue words windows of text are cut out, of a bounded number of words. A window is compressed by itself and
with each template as a raw dictionary; the templates are ranked by the bytes that they save. A template wins if, in
the order of the ranks, its words are found in the window with no more than a few differences, none of them in a name
or a number. Windows overlap: of notices found at the same place the one that saves most stays.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import whole

CUES = (
    r"(?i)licen[sc]e|permission (is hereby granted|to use)|redistribution and use|neither the name of|public domain"
    r"|related rights|\bCC(0|[ -]BY)|\b[LA]?GPL|\b[ME]PL"
)
DIFFERENT = 0.1  # share of a template's words that may differ

# fixed values: notices as their licenses word them, and the short forms that documents use
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "BSD-3-Clause": (
        "Released under the 3-Clause BSD License.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission.",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any "
        "later version.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version.",
    ),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.",),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC0-1.0": ("Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}

# fixed values: SPDX identifier, version, full names, short names
VERSIONED: tuple[tuple[str, str, tuple[str, ...], tuple[str, ...]], ...] = (
    ("Apache-2.0", "2.0", ("Apache License", "Apache Software License"), ()),
    ("GPL-2.0", "2", ("GNU General Public License",), ("GPL",)),
    ("GPL-3.0", "3", ("GNU General Public License",), ("GPL",)),
    ("LGPL-2.1", "2.1", ("GNU Lesser General Public License",), ("LGPL",)),
    ("LGPL-3.0", "3", ("GNU Lesser General Public License",), ("LGPL",)),
    ("AGPL-3.0", "3", ("GNU Affero General Public License",), ("AGPL",)),
    ("MPL-2.0", "2.0", ("Mozilla Public License",), ("MPL",)),
    ("EPL-2.0", "2.0", ("Eclipse Public License",), ("EPL",)),
    ("BSL-1.0", "1.0", ("Boost Software License",), ()),
)
# fixed values: SPDX identifier, names that stand without a version
UNVERSIONED: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", ("MIT License",)),
    ("ISC", ("ISC License",)),
    ("BSD-2-Clause", ("2-Clause BSD License", "BSD 2-Clause License", "Simplified BSD License")),
    ("BSD-3-Clause", ("3-Clause BSD License", "BSD 3-Clause License", "New BSD License")),
    ("Zlib", ("Zlib License",)),
)


def short_forms() -> dict[str, tuple[str, ...]]:
    """Templates of short notices: SPDX lines, names with a version however it is written, and names without a
    version after words that put something under them."""
    out: dict[str, list[str]] = {}
    for spdx, version, names, short in VERSIONED:
        numbers = [version] if "." in version else [version, f"{version}.0"]
        ids = [spdx, *[f"{spdx}-{end}" for end in ("only", "or-later")]] if "GPL" in spdx else [spdx]
        named = [f"{name}{how}{n}" for name in (*names, *short) for n in numbers for how in (" ", " version ", " v", " v. ")]
        joined = [f"licensed under {the}{name}v{n}" for name in short for n in numbers for the in ("", "the ", "the GNU ")]
        out[spdx] = [f"SPDX-License-Identifier: {i}" for i in ids] + named + joined
    for spdx, names in UNVERSIONED:
        out[spdx] = [f"SPDX-License-Identifier: {spdx}", *[f"{lead} the {name}" for name in names for lead in ("under", "terms of")]]
    for spdx in TEMPLATES:  # what has no short name
        out.setdefault(spdx, [f"SPDX-License-Identifier: {spdx}"] if spdx != "BSD" else [])
    return {name: tuple(texts) for name, texts in out.items()}


def known_licenses() -> dict[str, tuple[str, ...]]:
    """Notices and short forms."""
    short = short_forms()
    return {name: (*TEMPLATES.get(name, ()), *short.get(name, ())) for name in sorted({*TEMPLATES, *short})}


_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")
FOUND = "array<struct<license:string,start:int,end:int,saved:int,differences:array<string>>>"


def _words(text: str) -> list[tuple[str, int, int]]:
    return [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(text)]


def _parameters() -> zstandard.ZstdCompressionParameters:
    """The same with and without a dictionary: by itself the library takes those for tiny inputs with a small one."""
    return zstandard.ZstdCompressionParameters.from_level(3, source_size=1 << 12)


class Template:
    def __init__(self, name: str, text: str):
        self.name = name
        self.words = [w for w, _, _ in _words(text)]
        # names and numbers: words with a digit, or with a capital that does not open the template
        self.strict = {m[0].lower() for i, m in enumerate(_WORD.finditer(text)) if re.search(r"\d", m[0]) or i and re.search(r"[A-Z]", m[0])}
        raw = " ".join(self.words).encode()
        dictionary = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(compression_params=_parameters())
        self.compressor = zstandard.ZstdCompressor(dict_data=dictionary, compression_params=_parameters())


class Scanner:
    def __init__(self, templates: Mapping[str, Sequence[str]], cues: str = CUES):
        self.templates = [Template(name, text) for name, texts in templates.items() for text in texts]
        self.cues = re.compile(cues)
        unseen = [text for texts in templates.values() for text in texts if not self.cues.search(text)]
        if unseen:
            raise ValueError(f"no cue leads to the template {unseen[0]!r}")
        self.plain = zstandard.ZstdCompressor(compression_params=_parameters())
        self.reach = 2 + max((len(t.words) for t in self.templates), default=0) * 5 // 4

    def windows(self, text: str, words: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
        """First and last + 1 of the words around the cues, as far as the longest template reaches to either side.

        Cues within one reach share a window, so that none is longer than three, and windows grow with the words only.
        """
        out, place, head = [], 0, -1
        for mark in self.cues.finditer(text):
            while place < len(words) and words[place][2] <= mark.start():
                place += 1
            upto = min(len(words), place + self.reach)
            if 0 <= head and place - head <= self.reach:
                out[-1] = (out[-1][0], upto)
            else:
                out.append((max(0, place - self.reach), upto))
                head = place
        return out

    def ranked(self, words: list[str]) -> list[tuple[int, Template]]:
        """Templates by the bytes that they save, most first; a tie goes to the longer one.

        None is left out: what a short notice saves is no more than the words around it make a dictionary lose or win.
        """
        raw = " ".join(words).encode()
        alone = len(self.plain.compress(raw))
        saved = [(alone - len(t.compressor.compress(raw)), t) for t in self.templates]
        return sorted(saved, key=lambda s: (-s[0], -len(s[1].words), s[1].name))

    @staticmethod
    def differences(template: Template, words: list[str]) -> tuple[int, int, list[str]] | None:
        """Where the template stands in the words (first, last + 1) and how the wording differs; None if it does not."""
        if not template.strict.issubset(words):
            return None
        match = SequenceMatcher(None, template.words, words, autojunk=False).find_longest_match()
        if not match.size:
            return None
        slack = int(len(template.words) * DIFFERENT) + 1
        first = max(0, match.b - match.a - slack)
        near = words[first : match.b - match.a + len(template.words) + slack]
        codes = SequenceMatcher(None, template.words, near, autojunk=False).get_opcodes()
        while codes and codes[0][0] == "insert":
            codes.pop(0)
        while codes and codes[-1][0] == "insert":
            codes.pop()
        if not codes:
            return None
        changed, count = [], 0
        for kind, a, b, c, d in codes:
            if kind != "equal":
                if template.strict.intersection(template.words[a:b]):
                    return None
                count += max(b - a, d - c)
                changed.append(f"{' '.join(template.words[a:b])} > {' '.join(near[c:d])}")
        if count > DIFFERENT * len(template.words):
            return None
        return first + codes[0][3], first + codes[-1][4], changed

    def found(self, words: list[str]) -> list[tuple[int, Template, int, int, list[str]]]:
        """Bytes saved, template, first and last + 1 word, differences; a word that is taken is empty."""
        out, rest = [], list(words)
        while True:
            # what has been found is left out, and what is left is ranked again
            for saved, template in self.ranked([w for w in rest if w]):
                at = self.differences(template, rest)
                if at and "" not in rest[at[0] : at[1]]:
                    rest[at[0] : at[1]] = [""] * (at[1] - at[0])
                    out.append((saved, template, *at))
                    break
            else:
                return out

    def scan(self, text: str) -> list[dict]:
        """Licenses found, by their place; where notices overlap, the one that saves most wins."""
        spans = _words(text) if self.cues.search(text) else []
        rest, out = [w for w, _, _ in spans], []
        pending = self.windows(text, spans)
        while pending:
            every = [(f[0], f[1], f[2] + a, f[3] + a, f[4], (a, b)) for a, b in pending for f in self.found(rest[a:b])]
            # one that differs and ends where its window does is likely to be cut off there
            cut = lambda f: bool(f[4]) and (f[2] == f[5][0] or f[3] == f[5][1])
            every.sort(key=lambda f: (cut(f), -f[0], -len(f[1].words), f[1].name, f[2], f[3]))
            won, again = set(), set()
            for saved, template, first, last, differences, window in every:
                if "" not in rest[first:last]:
                    rest[first:last] = [""] * (last - first)
                    won.add((template, first, last))
                    out.append({"license": template.name, "start": spans[first][1], "end": spans[last - 1][2],
                                "saved": saved, "differences": differences})
                elif (template, first, last) not in won:
                    again.add(window)  # it has lost its place to a notice of another window
            pending = sorted(again)
        return sorted(out, key=lambda f: (f["start"], f["license"]))


def scan_licenses(docs: DataFrame, key: str, text: str, templates: Mapping[str, Sequence[str]] | None = None, cues: str = CUES) -> DataFrame:
    """(key, licenses) for every row: the licenses that a whole text names, with their place (characters), the bytes
    saved, and the differences in wording as ``template > text``. Nothing is shuffled; only texts with a cue go to
    Python workers.

    Templates are by default those of ``known_licenses``. A template in which no cue occurs is an error, as it would
    never be looked for. A null or empty text, or one without a cue, has an empty list. Null and repeated keys and other columns do no
    harm; one row per input row comes out. A key may have any name; ``licenses`` gives two columns of that name, the key first.
    """
    given = known_licenses() if templates is None else dict(templates)
    Scanner(given, cues)  # an error is raised here and not in a task
    schema = T.StructType([T.StructField("_key", docs.schema[key].dataType), T.StructField("licenses", T._parse_datatype_string(FOUND))])
    kind = pa.list_(
        pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("saved", pa.int32()),
                   ("differences", pa.list_(pa.string()))])
    )

    def work(batches):
        scanner = Scanner(given, cues)
        for batch in batches:
            found = [scanner.scan(t) if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=schema.names)

    body = whole(F.col(text))
    texts = docs.select(F.col(key).alias("_key"), F.when(F.regexp(body, F.lit(cues)), body).alias("_text"))
    return texts.mapInArrow(work, schema).withColumnRenamed("_key", key)
