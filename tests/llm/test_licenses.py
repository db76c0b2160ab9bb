from __future__ import annotations

import textwrap

from pricetide.llm.common import read
from pricetide.llm.licenses import NAMES, NOTICES, TEXTS, scan_licenses

MIT = TEXTS["MIT"]


def scanned(spark, rows):
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, digest string")
    return sorted((tuple(r) for r in scan_licenses(frame).collect()), key=repr)


def test_whole_texts_and_lines(spark):
    changed = "COPYRIGHT (c) 2020 Somebody\nAll rights reserved.\n\n" + MIT.upper().replace(",", " ;").replace("LICENSE", "LICENCE")
    notice = "Once upon a time.\nThis work is licensed under the GNU General Public License, version 3.\nThe end."
    rows = [
        (1, MIT), (2, changed), (3, notice), (4, MIT + "\nand one more line"), (5, None), (6, ""), (7, "!!!\n\n"),
        (8, "released UNDER the mit licence"), (9, notice.replace("version 3", "version 4")),
        (10, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.\r\nLicensed under CC BY-NC 4.0."), (1, "x"),
        (11, "# My tool\n\n" + MIT + "\n\nimport this\n\nmore code"),
    ]
    found = scanned(spark, rows)
    by_id = {(r[0], r[2], r[3], r[4]) for r in found}
    assert len(found) == len(rows)
    assert (1, "MIT", "MIT", 1) in by_id and (2, "MIT", "MIT", 1) in by_id and (1, None, "", 0) in by_id
    assert (3, None, "GPL-3.0", 1) in by_id and (9, None, "", 0) in by_id and (4, None, "", 0) in by_id and (11, None, "MIT", 1) in by_id
    assert (8, "MIT", "MIT", 1) in by_id and (10, None, "CC-BY-NC-4.0,MIT", 3) in by_id
    assert {r[1] for r in found if r[0] in (5, 6, 7)} == {0}
    assert scanned(spark, [])== []


def test_every_known_text_is_found(spark):
    rows = [(n, w.format(s)) for n, ways in NAMES.items() for s in ways for w in NOTICES] + list(TEXTS.items())
    found = scanned(spark, [(i, text) for i, (_, text) in enumerate(rows)])
    assert [(r[0], r[2]) for r in sorted(found)] == [(i, name) for i, (name, _) in enumerate(rows)]


def rewrapped(text, width):
    """Each paragraph filled anew; without a width it is one line."""
    parts = [" ".join(p.split()) for p in text.split("\n\n")]
    return "\n\n".join(textwrap.fill(p, width, break_long_words=False, break_on_hyphens=False) if width else p for p in parts)


def test_line_breaks_change_nothing(spark):
    """Every whole text at all widths and unwrapped, with a title or not, with copyright lines or not, at a head of code."""
    rows, want = [], {}
    for name, text in TEXTS.items():
        title, _, body = text.partition("\n\n")
        bare = body if title.lower().endswith("license") else text
        for width in [None, *range(40, 201, 5)]:
            for kind in range(4):
                told = rewrapped(text if kind % 2 else bare, width)
                if kind // 2:
                    told = "Copyright (c) 2019-2021 Some Body <some@body.org>\n© 2022 Copyright Owners Inc.\nAll rights reserved.\n\n" + told
                want[len(rows)] = (name, name, 1)
                rows.append((len(rows), told))
        want[len(rows)] = (None, name, 1)
        rows.append((len(rows), "/*\n\n" + rewrapped(bare, 60) + "\n\n*/\nint main;\n\nreturn 0;"))
    found = {r[0]: (r[2], r[3], min(r[4], 1)) for r in scanned(spark, rows)}
    assert {i: found[i] for i in want if found[i] != want[i]} == {}


def test_edges(spark):
    """Very long texts, repeated rows, ties: a block twice counts twice, most of a block does not count."""
    body = MIT.partition("\n\n")[2]
    long = "\n\n".join(["word " * 50] * 4000)
    rows = [(1, long + "\n\n" + body), (2, body + "\n\n" + body), (2, body + "\n\n" + body), (3, "x\n\n" + body[:-40] + "\n\ny")]
    rows += [(4, "x\n\n" + "\n\n".join(reversed(body.split("\n\n")))), (None, "Copyright\n\nnotice"), (6, "copyright holders be liable\nreleased under the MIT License")]
    found = {(r[0], r[2], r[3], r[4]) for r in scanned(spark, rows)}
    assert found == {(1, None, "MIT", 1), (2, None, "MIT", 2), (3, None, "", 0), (4, None, "", 0), (None, None, "", 0), (6, None, "MIT", 1)}
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_notices_in_the_documents(spark):
    lines = {
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
        "Released under the MIT License.": "MIT",
    }
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    want = {
        r.doc_id: ",".join(sorted({lines[x] for x in r.text.split("\n") if x in lines})) for r in docs.collect()
    }
    assert {r.doc_id: r.licenses for r in scan_licenses(docs).collect()} == want
    assert sum(bool(v) for v in want.values()) > 10
