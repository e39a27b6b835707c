"""Full, hard-wrapped licence texts and notices."""

import pytest

from quillspark.llm import license_scan

AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES\nWITH REGARD TO THIS SOFTWARE.'
BSD2 = """Copyright (c) 2001, Some One
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright
   notice, this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = (
    BSD2
    + """3. Neither the name of Example Inc. nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
)
ISC = (
    """Copyright 2004 Some One

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

"""
    + AS_IS
)
MIT = (
    """MIT License

Copyright (c) 2019 Some One

Permission is hereby granted, free of charge, to any person obtaining a
copy of this software and associated documentation files, to deal in it
without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be
included in all copies or substantial portions of the Software.

"""
    + AS_IS
)
GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.
"""
GPL2 = GPL3.replace("Foundation, either version 3", "Foundation; either version 2")
LGPL = GPL3.replace("GNU General", "GNU Lesser General")


def commented(text: str) -> str:
    return "/*\n" + "".join(f" * {line}".rstrip() + "\n" for line in text.split("\n")) + " */\nint main(void);\n"


CASES = [
    (BSD2, ["BSD-2-Clause"]),
    (BSD3, ["BSD-3-Clause"]),
    (ISC, ["ISC"]),
    (MIT, ["MIT"]),
    (GPL3, ["GPL-3.0-or-later"]),
    (GPL2, ["GPL-2.0-or-later"]),
    (LGPL, ["LGPL"]),
    (" ".join(GPL3.split()), ["GPL-3.0-or-later"]),
    (BSD2 + "\n" + BSD3, ["BSD-2-Clause", "BSD-3-Clause"]),
    (GPL2 + "\n" + GPL3, ["GPL-2.0-or-later", "GPL-3.0-or-later"]),
    # What stands between a rule's sentences is kept.
    (BSD2.replace("2. Redis", "Docs are licensed under the MIT\nlicense.\n2. Redis"), ["BSD-2-Clause", "MIT"]),
    # One sentence, several licences.
    ("Code is released under the MIT license, texts are CC BY-SA 4.0 or CC0", ["CC-BY-SA", "CC0", "MIT"]),
    ("GNU General Public License, version 2\nor later", ["GPL-2.0-or-later"]),
    ("GNU General Public License v3", ["GPL-3.0"]),
    ("See the\nGNU General Public License.", ["GPL"]),
    # No cue but the licence's own name.
    ("Pictures: CC-BY 4.0", ["CC-BY"]),
    ("# SPDX-License-Identifier: MIT\n# Copyright 2020 Some One\nimport os", ["MIT"]),
    ("A version of the above, as is.", []),
]


@pytest.mark.parametrize("wrap", [str, commented, lambda t: t.replace("\n", "\r\n")])
def test_whole_texts(spark, wrap):
    rows = [(k, wrap(text)) for k, (text, _) in enumerate(CASES)]
    got = license_scan.recognise(spark.createDataFrame(rows, "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["licenses"]) for r in got] == [(k, want) for k, (_, want) in enumerate(CASES)]
    assert got[0]["sentence_ids"] == ["reserved", "bsd_grant", "bsd_source", "bsd_binary"] and got[0]["all_rights_reserved"]
