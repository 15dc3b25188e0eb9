"""The license scan's keywords, rules and resolution."""

import random
import re
import time

import pytest
from seedloom.llm import licenses


def made_up(pattern, r):
    """A text that the pattern matches."""
    out = []
    for op, arg in re._parser.parse(pattern):
        name = str(op)
        if name == "LITERAL":
            out.append(chr(arg))
        elif name == "IN":
            kind, x = arg[0]
            out.append(chr(x if str(kind) == "LITERAL" else x[0]))
        elif name == "BRANCH":
            out.append(parsed(r.choice(arg[1]), r))
        elif name == "SUBPATTERN":
            out.append(parsed(arg[-1], r))
        elif name == "MAX_REPEAT":
            out.append("".join(parsed(arg[2], r) for _ in range(r.randint(arg[0], min(9, arg[1])))))
        elif name == "ANY":
            out.append("z")
        else:
            assert name in ("ASSERT", "ASSERT_NOT")
    return "".join(out)


def parsed(tree, r):
    whole, re._parser.parse = re._parser.parse, lambda x: x
    try:
        return made_up(tree, r)
    finally:
        re._parser.parse = whole


def samples(times=6):
    r = random.Random(2)
    return [(k, keys, made_up(pattern, r)) for _ in range(times) for k, keys, pattern, _, _ in licenses.rules()]


def test_each_match_has_the_keywords():
    for k, keys, words in samples(40):
        assert keys and set(keys) <= set(words.split()), (k, keys, words)


def plain(words):
    """Detections by trying every rule at every place, resolved one after the other."""
    text = " " + " ".join(words) + " "
    found = sorted((m.start(), -m.end(), k, label) for k, _, pattern, label, _ in licenses.rules() for m in re.finditer(pattern, text))
    out = []
    for s, back, k, label in found:
        if not out or s >= out[-1][1]:
            out.append((s, -back, k, label))
        elif -back > out[-1][1] and k < out[-1][2]:
            out[-1] = (s, -back, k, label)
    return out


def test_resolution_against_a_plain_version(spark):
    r = random.Random(3)
    texts = []
    for k in range(150):
        parts = [r.choice(samples_once)[2] if r.random() < 0.7 else r.choice(["some text", "und mit", "the license of", "copyright"]) for _ in range(r.randint(1, 4))]
        text = "".join(r.choice("\n -,_") if c == " " else c for c in " ".join(parts))
        texts.append((k, r.choice(["", "\n", "é ", "Some text. "]) + (text.upper() if r.random() < 0.3 else text) + r.choice(["", ".", "\nmore"]), "x"))
    rows, (_, _, found, _) = licenses.scan(spark.createDataFrame(texts, "k int, text string, Places string"))
    for row in rows.collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", row["text"].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZÉ", "abcdefghijklmnopqrstuvwxyzé")))
        assert [(x["s"], x["e"], x["rank"], x["label"]) for x in row[found]] == plain(words), row["text"]


samples_once = samples(2)

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including
without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software. The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED"""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above
copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution."""


@pytest.mark.parametrize(("text", "labels"), [
    (MIT, {"mit"}), (BSD, {"bsd"}),
    (BSD + " Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", {"bsd", "bsd-3-clause"}),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", {"isc"}),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", {"0bsd"}),
    ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", {"apache-2"}),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", {"gpl-3"}),
    ("you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version", {"lgpl-2"}),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", {"mpl-2"}),
    ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", {"unlicense"}),
    ("The origin of this software must not be misrepresented; you must not claim that you wrote the original software.", {"zlib"}),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", {"epl-2"}),
    ("Released under Apache 2.0.", {"apache-2"}), ("Distributed under the terms of BSD-3-Clause", {"bsd-3-clause"}), ("GPL v3 or later", {"gpl-3"}), ("All rights\nreserved.", {"all-rights-reserved"}),
    ("Dedicated to the public\ndomain", {"public-domain"}), ("Released into the public  domain", {"public-domain"}), ("Released under MIT", {"mit"}), ("Zero-Clause BSD license", {"0bsd"}), ("0BSD licensed", {"0bsd"}),
    ("GNU Library General Public License version 2", {"lgpl-2"}), ("a licence to kill, no software", set()), ("Der Hund mit der Katze, free of charge", set()), ("permission granted to leave, any person obtaining a copy", set()),
])
def test_labels(spark, text, labels):
    rows, (_, _, found, _) = licenses.scan(spark.createDataFrame([(text,)], "text string"))
    assert {x["label"] for x in rows.first()[found]} == labels


def test_many_places(spark):
    start = time.monotonic()
    rows, (_, places, found, _) = licenses.scan(spark.createDataFrame([("under the MIT license " * 100_000,)], "text string"))
    got = rows.select(places, found).first()
    assert [p["w"] for p in got[0]] == list(range(0, 400_000, 4)) and len(got[1]) == 100_000
    assert time.monotonic() - start < 90
