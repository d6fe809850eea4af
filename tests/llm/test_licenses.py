import math

import pytest

from colloquy.llm import licenses as li


def judged(line):
    """(family or None if the classifier says unknown, whether it is confirmed, probability, similarity) of a paragraph."""
    model, seq = li.train(), li.words(line)
    grams = li.ngrams(seq)
    z = [b + sum(model.weights[g][k] for g in grams if g in model.weights) for k, b in enumerate(model.bias)]
    k = z.index(max(z))
    p = 1 / sum(math.exp(v - z[k]) for v in z)
    family = model.families[k]
    if family == li.UNKNOWN:
        return None, False, p, 0.0
    near = dict.fromkeys(model.families, 0.0)
    for name, many in li.templates().items():
        for t in many:
            own = set(li.confirming(t))
            if li.order(t) < 3 or set(li.versions(t)) <= set(seq):
                near[name] = max(near[name], len(own & grams) / len(own))
    return family, near[family] >= max(li.CONFIRM, *near.values()), p, near[family]


def brute(text):
    """(paragraph, family, probability, similarity) of a text whose paragraphs are lines or not confirmed as a whole."""
    out = []
    for i, line in enumerate((text or "").split("\n")):
        if any(k in line.lower() for k in li.keys()):
            family, sure, p, near = judged(line)
            if family and (sure or p >= li.LIKELY):
                out.append((i, family if sure else li.UNKNOWN, round(p, 6), round(near, 6)))
    return out


TEXTS = [None, "", "prose\nReleased under the MIT License.\nmore", "licensed under cc by-nc 4.0.", "Licensed under CC BY 4.0. Enjoy", "driver's license plate", "Copyright 2020 somebody", "x " * 5000 + "This work is licensed under the GNU General Public License, version 3. end", "license", "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0.\n\nLicensed under the Apache License"]


def test_scan_equals_plain_evaluation(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, TEXTS[2])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, family string")
    got = sorted(((r["doc_id"], r["paragraph"], r["family"], round(r["probability"], 6), round(r["similarity"], 6)) for r in li.scan(df).collect()), key=str)
    assert got == sorted(((d, *x) for d, t in rows for x in brute(t)), key=str)
    assert li.scan(df.limit(0)).count() == 0


@pytest.mark.parametrize("family", sorted(li.TEMPLATES))
def test_every_template_is_recognised(family):
    for t in li.templates()[family]:
        (found,) = brute("see " + t.upper() + " here")
        assert found[1] == family and found[2] > 0.3, t


def test_other_paragraphs_are_no_rows(spark):
    lines = ["He lost his driving licence.", "my driving license was lost", "copyright law is a field of study", "public license domain version free", "the software was subject to following rights without materials", "version 3.0 of the song, 2.0 of the film", "chapter 4.0"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    assert [(r["doc_id"], r["family"]) for r in li.scan(df).collect() if r["family"] != li.UNKNOWN] == []
    assert li.scan(df).where("doc_id in (0, 1, 2, 5, 6)").count() == 0


#: Texts that users have; none is a template as it stands.
NOTICES = {
    "MIT License": "mit",
    "The MIT License (MIT)": "mit",
    "SPDX-License-Identifier: Apache-2.0": "apache-2.0",
    "// SPDX-License-Identifier: MIT": "mit",
    "license = GPL-2.0-or-later": "gpl-2.0",
    "GPL-2.0-or-later": "gpl-2.0",
    "This document is available under the terms of the Mozilla Public License 2.0": "mpl-2.0",
    "CC BY-SA 3.0": "cc-by-sa-3.0",
    "Photo: CC BY-SA 3.0, cropped": "cc-by-sa-3.0",
    "CC0": "cc0-1.0",
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.": "lgpl-2.1",
    "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "lgpl-3.0",
    "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted": "isc",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.": "gpl-2.0",
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.": "apache-2.0",
    "This file is part of the thing and is distributed under the Boost Software License, Version 1.0. (See accompanying file)": "bsl-1.0",
    "The software is released under the BSD 3-Clause License, see LICENSE.txt": "bsd-3-clause",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License": "cc-by-sa-3.0",
}


def test_notices_that_users_have(spark):
    df = spark.createDataFrame([(i, f"prose before\n\n{x}\n\nprose after") for i, x in enumerate(NOTICES)], "doc_id long, text string")
    got = {r["doc_id"]: r["family"] for r in li.scan(df).where("paragraph = 2").collect()}
    assert {x: got.get(i) for i, x in enumerate(NOTICES)} == NOTICES


def test_a_confirmed_notice_leaves_no_lines_behind(spark):
    text = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version."""
    (r,) = li.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (r["family"], r["lines"], r["paragraph"]) == ("lgpl-2.1", 4, 0)


#: The licence lines of the given tables, and short forms of two families.
LINES = {
    "Licensed under the Apache License, Version 2.0.": "apache-2.0",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0",
    "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0",
    "Released under the MIT License.": "mit",
    "All rights reserved.": "proprietary",
    "Copyright 2024 X. All rights reserved.": "proprietary",
    "(c) 2019 Some Body Ltd, all  rights reserved": "proprietary",
    "Available under CC BY 4.0.": "cc-by-4.0",
    "Available under CC BY-NC 4.0.": "cc-by-nc-4.0",
    "Text: CC-BY-4.0, see below": "cc-by-4.0",
    "The photographs are available under CC-BY-4.0": "cc-by-4.0",
    "Creative Commons Attribution 4.0": "cc-by-4.0",
}


def test_every_licence_line_is_reported_with_its_family(spark):
    df = spark.createDataFrame([(i, f"some prose\n\n{line}\n\nmore") for i, line in enumerate(LINES)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["paragraph"], r["family"]) for r in li.scan(df).collect())
    assert got == [(i, 2, family) for i, family in enumerate(LINES.values())]


def test_no_paragraph_without_a_key_can_be_confirmed():
    for many in li.templates().values():
        for t in many:
            own = li.confirming(t)
            assert sum(not any(k in g for k in li.keys()) for g in own) < li.CONFIRM * len(own)


def test_a_confirmed_line_is_reported_without_the_usual_words(spark):
    line = "is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    (r,) = li.scan(spark.createDataFrame([(1, line)], "doc_id long, text string")).collect()
    assert (r["paragraph"], r["family"]) == (0, "mit")


WRAPPED = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction""",
    "bsd-3-clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:""",
    "gpl-3.0": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "proprietary": "(c) 2020 X. All rights\nreserved.",
}


@pytest.mark.parametrize("leader", ["", " * ", "# ", "// ", "dnl ", ";; "])
def test_wrapped_notices_are_found(spark, leader):
    rng = __import__("random").Random(4)
    prose = lambda: " ".join(rng.choice("the of a to in is and for you it with file text page".split()) for _ in range(14))
    before, rows = ["", "\n", "one\n\n", "\x01 7\x01\n12\n"], []
    for i, text in enumerate(WRAPPED.values()):
        rows.append((i, before[i] + leader.rstrip() + "\n" + "\n".join(leader + x for x in text.split("\n")) + "\n" + leader.rstrip() + "\nend"))
        rows.append((10 + i, "\n".join([prose() for _ in range(9)] + text.split("\n") + [prose() for _ in range(9)])))
    rows.append((20, "a\nReleased under the MIT License.\nb"))
    got = li.scan(spark.createDataFrame(rows, "doc_id long, text string")).where("family <> 'unknown'").collect()
    want = []
    for i, (family, text) in enumerate(WRAPPED.items()):
        n = text.count("\n") + 1
        want.append((i, before[i].count("\n") + 1 if leader or before[i] != "" else 1, n, family))
        want.append((10 + i, 0, 18 + n, family))
    assert sorted((r["doc_id"], r["paragraph"], r["lines"], r["family"]) for r in got) == sorted([*want, (20, 1, 1, "mit")])
