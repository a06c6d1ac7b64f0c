"""Names, versions and negations decide: near texts of other licences are confirmed as none; exact wordings are always found."""

import pytest

from arbora.llm import licenses
from conftest import DATA


@pytest.mark.parametrize(
    "text, name",
    [
        ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "CC-BY-ND-4.0"),
        ("This work is licensed under a Creative Commons Attribution 3.0 International License.", None),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivs 4.0 International License.", None),
        ("This work is licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0"),
        ("This work is licensed under the GNU Lesser General Public License, version 2.1.", "LGPL-2.1"),
        ("This work is licensed under the GNU General Public License, version 1.", None),
        ("Licensed under the Apache License, Version 1.1.", None),
        ("This project is not licensed under the terms of the MIT license.", None),
        ("The files are never released under the MIT License.", None),
        ("// SPDX-License-Identifier: Zlib\n", "Zlib"),
        ("// SPDX-License-Identifier: EPL-2.0\n", "EPL-2.0"),
        ("// SPDX-License-Identifier: Frobnicated-7.0\n", None),
        ("Licensed under CC BY 3.0.", None),
        ("Licensed under CC BY-NC-SA 4.0.", None),
        ("The work isn't cheap. Released under the MIT License.", "MIT"),
        (licenses.WORDINGS[3][1].replace("without restriction", "with restriction"), "MIT"),
        (licenses.WORDINGS[3][1].replace("is hereby granted", "is not hereby granted"), None),
    ],
)
def test_names_versions_and_negations_must_agree(text, name):
    found = licenses.scan("Some prose first.\n" + text + "\nMore prose.")
    assert [f.license for f in found if f.confirmed] == ([name] if name else [])
    assert all(f.license is None for f in found if not f.confirmed)


def test_exact_wordings_are_found_by_every_run_of_words(spark):
    """Each run of words of the documents that is a template's wording lies in a confirmed block of that licence, or of a longer one."""
    wanted = {}
    for (name, _), own in zip(licenses.TEMPLATES, licenses.template_words(), strict=True):
        wanted.setdefault(tuple(own), set()).add(name)
    lengths, n = sorted({len(w) for w in wanted}), 0
    for (text,) in spark.read.parquet(f"{DATA.replace("sf0.001", "sf0.01")}/documents.parquet").where("text is not null").select("text").collect():
        spots = [(m.start(), m.end(), licenses.WRAPPED.sub("-", m.group().lower())) for m in licenses.WORD.finditer(text)]
        own = [w for _, _, w in spots]
        found = [f for f in licenses.scan(text) if f.confirmed] if licenses.HINT.search(text) else []
        for size in lengths:
            for at in range(len(own) - size + 1):
                names = wanted.get(tuple(own[at : at + size]))
                if names and names != {licenses.NOBODYS} and not licenses.negated(text, spots[at][0]):
                    a, b = spots[at][0], spots[at + size - 1][1]
                    assert any(f.start <= a and b <= f.end and (f.license in names or f.end - f.start > b - a + 1) for f in found), text[a:b]
                    n += 1
    assert n > 10
