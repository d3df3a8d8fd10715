"""Short license notices: compressed and confirmed as all others, in time that long texts of license words bear."""

import time

import pytest

from quillon.llm import license_scan

OWN = license_scan.scanner()


@pytest.mark.parametrize(
    "text, want",
    [
        ("SPDX-License-Identifier: MIT", ["MIT"]),
        ("// SPDX-License-Identifier: GPL-2.0-or-later", ["GPL-2.0-or-later"]),
        ("SPDX-License-Identifier: Foo-Bar-9", []),
        ("GNU GPL v3", ["GPL-3.0"]),
        ("see the GNU LGPL, version 2.1, for more", ["LGPL-2.1"]),
        ("GNU GPL v7", []),
        ("MIT License", ["MIT"]),
        ("The MIT License (MIT)", ["MIT"]),
        ("This project is licensed under the Apache License 2.0.", ["Apache-2.0"]),
        ("Licensed under CC BY-NC-SA 4.0", ["CC-BY-NC-SA-4.0"]),
        ("Licensed under CC BY-ND 3.0", ["CC-BY-ND-3.0"]),
        ("This work is licensed under the Creative Commons Attribution-ShareAlike 3.0", ["CC-BY-SA-3.0"]),
        ("This work is licensed under the Creative Commons Attribution-NoDerivatives 4.0 International License", ["CC-BY-ND-4.0"]),
        ("Licensed under the Creative Commons Attribution-NonCommercial-ShareAlike 2.5", ["CC-BY-NC-SA-2.5"]),
        ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0", ["EPL-1.0"]),
        ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", ["EPL-2.0"]),
    ],
)
def test_short(text, want):
    found = OWN.scan(text)
    assert [x["license"] for x in found] == want
    for x in found:  # figures are measured, none is assumed
        assert 0 < x["reduction"] < 1 and 0 < x["wording"] <= 1 and text[x["at"] : x["end"]].strip()


def test_zlib_in_lines():
    text = license_scan.TEMPLATES["Zlib"].replace(". ", ".\n\n ")
    assert [x["license"] for x in OWN.scan("Copyright\n\n" + text)] == ["Zlib"]


@pytest.mark.parametrize("words", ["licensed under the license ", "licensed under the apache license ", "permission is hereby granted free of charge ", "licensed under cc by ", "gnu general public license "])
def test_repeated_license_words_take_time_in_proportion(words):
    def took(n):
        began = time.perf_counter()
        assert OWN.scan(words * n) == []
        return time.perf_counter() - began

    n = 200_000 // len(words)
    assert took(n) < max(5.0, 20 * took(n // 10))
